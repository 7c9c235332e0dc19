"""The golden records beside given ones that have an id of theirs."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_a_given_incident_of_the_golden_id(spark, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        shifted = "SELECT * REPLACE (event_id + 849201 - (SELECT min(event_id) FROM e) AS event_id) FROM e" if t == "events" else "SELECT * FROM e"
        con.execute(f"COPY (WITH e AS (SELECT * FROM '{SF}/{t}.parquet') {shifted}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert con.execute("SELECT count(*) FROM events WHERE event_id = 849201").fetchone() == (1,)
    got = sorted(map(tuple, entry.queries()["golden_seed"](spark, str(tmp_path)).select("system_id", "rule_id", "severity", "n_violations").collect()))
    assert got == sorted(con.execute(f"SELECT system_id, rule_id, severity, n_violations FROM ({entry.oracle_sql()['golden_seed']})").fetchall())
