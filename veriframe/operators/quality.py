"""Data-quality gates: schema counts, references, magnitudes and assertions, each a row with what was expected."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.sources.schemas import REFERENCES, TABLES

Tables = Mapping[str, DataFrame]
#: What the registry must hold, the columns of the magnitude gate, and its bound.
EXPECTED = {"tables": 27, "references": 21, "ns_columns": 8}
NS_COLUMNS = [("gxp_systems", "last_backup_test_ns"), ("risks", "last_review_date_ns"), ("incidents", "opened_date_ns"), ("access_reviews", "scheduled_date_ns"), ("suppliers", "reassessment_due_date_ns"), ("periodic_evaluations", "due_date_ns")]
LEAST_NS = 10**18


def tables_gate(t: Tables, needed: Mapping[str, list[str]]) -> DataFrame:
    """(table_name, n_columns, n_missing, n_times, n_rows, passed) of the tables given: their columns, those of ``needed`` that they lack, those that hold times, and their rows."""

    def one(name: str) -> DataFrame:
        fields = t[name].schema.fields
        missing = set(needed[name]) - {f.name for f in fields}
        times = sum(f.dataType.typeName().startswith("timestamp") or f.name.endswith("_ns") for f in fields)
        rows = t[name].agg(F.count("*").alias("n_rows"))
        return rows.select(F.lit(name).alias("table_name"), F.lit(len(fields)).alias("n_columns"), F.lit(len(missing)).alias("n_missing"), F.lit(times).alias("n_times"), "n_rows", F.lit(not missing).alias("passed"))

    return reduce(DataFrame.unionByName, (one(name) for name in needed))


def record_columns_gate(t: Tables, names: list[str]) -> DataFrame:
    """(table_name, n_unknown, n_ns, n_rows, passed) of record tables: columns that the registry has with another type, its ``_ns`` columns that are present as longs, and rows."""

    def one(name: str) -> DataFrame:
        known = {f.name: f.dataType for f in T._parse_datatype_string(TABLES[name]).fields}
        own = t[name].schema.fields
        wrong = sum(f.name in known and f.dataType != known[f.name] for f in own)
        ns = sum(f.name.endswith("_ns") and f.dataType == T.LongType() for f in own)
        rows = t[name].agg(F.count("*").alias("n_rows"))
        return rows.select(F.lit(name).alias("table_name"), F.lit(wrong).alias("n_unknown"), F.lit(ns).alias("n_ns"), "n_rows", F.lit(wrong == 0).alias("passed"))

    return reduce(DataFrame.unionByName, (one(name) for name in names))


def schema_gate(spark: SparkSession, t: Tables | None = None, names: list[str] | None = None) -> DataFrame:
    """(gate, expected, actual, passed) of the registry itself; with tables also how many of it ``names`` of them make, with n_rows in them: (gate, expected, actual, passed, n_made, n_rows)."""
    columns = [(table, f) for table, ddl in TABLES.items() for f in T._parse_datatype_string(ddl).fields]
    actual = {"tables": len(TABLES), "references": len(REFERENCES), "ns_columns": sum(f.name.endswith("_ns") and f.dataType == T.LongType() for _, f in columns)}
    gates = spark.createDataFrame([(k, v, actual[k], actual[k] == v) for k, v in EXPECTED.items()], "gate string, expected int, actual int, passed boolean")
    if t is None or names is None:
        return gates
    ns = [(n, c) for n in names for c, kind in t[n].dtypes if c.endswith("_ns") and kind == "bigint"]
    met = [r for r in REFERENCES if r[0] in names and r[2] in names and r[1] in t[r[0]].columns]
    made = [(k, len(x), sorted({i[0] for i in x})) for k, x in (("tables", [(n,) for n in names]), ("references", met), ("ns_columns", ns))]
    rows = reduce(DataFrame.unionByName, (t[n].agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names))
    asked = spark.createDataFrame(made, "gate string, n_made int, of array<string>").select("gate", "n_made", F.explode("of").alias("table_name"))
    return gates.join(asked.join(rows, "table_name").groupBy("gate", "n_made").agg(F.sum("n_rows").alias("n_rows")), "gate")


def orphans(t: Tables, references: list[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column_name, parent, n_orphans): references that aren't null and that no parent has."""

    def one(child: str, column: str, parent: str, key: str) -> DataFrame:
        keys = t[parent].select(F.col(key).alias(column))
        lost = t[child].where(F.col(column).isNotNull()).select(column).join(keys, column, "left_anti")
        return lost.agg(F.count("*").alias("n_orphans")).select(F.lit(child).alias("child"), F.lit(column).alias("column_name"), F.lit(parent).alias("parent"), "n_orphans")

    return reduce(DataFrame.unionByName, (one(*r) for r in references))


def ns_guard(t: Tables, least: int = LEAST_NS) -> DataFrame:
    """(table_name, column_name, n_values, n_below, passed): times that can't be nanoseconds."""

    def one(name: str, column: str) -> DataFrame:
        return t[name].agg(F.count(column).alias("n_values"), F.count_if(F.col(column) < F.lit(least)).alias("n_below")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "n_values", "n_below")

    return reduce(DataFrame.unionByName, (one(*c) for c in NS_COLUMNS)).withColumn("passed", F.col("n_below") == 0)


def assert_equal(t: Tables, assertions: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """``assertions`` (label, table, id, column, expected as text) -> (label, expected, actual, passed); a missing row has a null actual and fails."""
    spark = t[assertions[0][1]].sparkSession
    wanted = spark.createDataFrame(assertions, "label string, tab string, id string, col string, expected string")

    def one(name: str, column: str) -> DataFrame:
        ids = [a[2] for a in assertions if (a[1], a[3]) == (name, column)]
        return t[name].where(F.col("id").isin(ids)).select(F.lit(name).alias("tab"), F.col("id"), F.lit(column).alias("col"), F.col(column).cast("string").alias("actual"))

    actual = reduce(DataFrame.unionByName, (one(*x) for x in sorted({(a[1], a[3]) for a in assertions})))
    return wanted.join(actual, ["tab", "id", "col"], "left").select("label", "expected", "actual", F.col("actual").eqNullSafe(F.col("expected")).alias("passed"))
