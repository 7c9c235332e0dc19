"""Record tables projected from the driver's Parquet tables, and small literal ones.

Each projection is a lazy DataFrame over the Parquet scan: only what a query reads is scanned. Times of the order and
event tables are shifted so that one clock, NOW_NS, serves all tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions.clock import NS_PER_DAY, epoch_ns
from veriframe.operators.duties import PERMISSIONS
from veriframe.sources.schemas import TABLES

#: The clock of all queries: 2025-08-20 00:00 UTC; what orders (from 2001-06-01) and events (from 2024-01-20) are shifted by.
NOW_NS = 1_755_648_000_000_000_000
ORDERS_SHIFT = NOW_NS - 991_353_600_000_000_000
EVENTS_SHIFT = NOW_NS - 1_705_708_800_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A record table without rows, as where its source can't be reached."""
    return spark.createDataFrame([], TABLES[name])


def read_source(spark: SparkSession, name: str, read: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """What ``read`` gives and True; the record table without rows and False (``source_available``) where its source can't be read."""
    try:
        rows = read()
        rows.schema  # fails here where the source is absent
        return rows, True
    except AnalysisException:
        return empty(spark, name), False


def source_status(spark: SparkSession, sources: Mapping[str, tuple[DataFrame, bool]]) -> DataFrame:
    """(table_name, source_available, n_rows) of sources as from read_source."""
    parts = [rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(known).alias("source_available"), "n_rows") for name, (rows, known) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def rows_of(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """A record table of literal rows; columns that a row leaves out are null."""
    frame = empty(spark, name)
    return spark.createDataFrame([tuple(r.get(c) for c in frame.columns) for r in rows], frame.schema)


class Records:
    """The record tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @property
    def gxp_systems(self) -> DataFrame:
        return self._read("nation").selectExpr(
            "concat('SYS-', n_nationkey) AS id", "n_name AS name", "'OPERATIONAL' AS lifecycle_state", "true AS gxp_impact",
            f"{NOW_NS}L - 31 * cast(n_nationkey AS bigint) * {NS_PER_DAY}L AS last_backup_test_ns",
        )

    @property
    def documents(self) -> DataFrame:
        labels = self._read("labels").select("doc_id", "quality")
        number = "try_cast(substring(source, 4) AS int)"
        return self._read("documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left").selectExpr(
            "concat('DOC-', doc_id) AS id", "concat('SYS-', doc_id % 25) AS system_id",
            f"CASE WHEN {number} % 4 = 0 THEN 'O&M' WHEN {number} % 4 = 1 THEN 'URS' ELSE 'SOP' END AS doc_type",
            "CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS author", "CASE WHEN quality IS NOT NULL THEN timestamp_ntz'2024-01-01 00:00:00' END AS created_date",
            "n_chars < 500 AS is_copy", "CASE quality WHEN 1 THEN 'APPROVED' WHEN 0 THEN 'DRAFT' END AS status", "doc_id", "n_chars",
        )

    @property
    def document_source(self) -> DataFrame:
        """What the documents' own texts say of them."""
        return self._read("documents").select(F.expr("concat('DOC-', doc_id)").alias("id"), F.char_length("text").cast("long").alias("n_chars"))

    @property
    def document_archive(self) -> DataFrame:
        """The documents under retention: those that were labelled."""
        return self._read("labels").select(F.expr("concat('DOC-', doc_id)").alias("id"))

    @property
    def document_events(self) -> DataFrame:
        """Events of documents, numbered as they were recorded: a user's events are those of the document of that number."""
        return self._read("events").select(F.expr("concat('DOC-', user_id)").alias("subject"), F.col("event_id").alias("seq"), epoch_ns("ts").alias("at"))

    @property
    def _orders(self) -> DataFrame:
        customers = self._read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        return self._read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(customers, "o_custkey")

    @property
    def access_reviews(self) -> DataFrame:
        return self._orders.select(
            F.expr("concat('AR-', o_orderkey)").alias("id"), F.expr("concat('SYS-', c_nationkey)").alias("system_id"),
            (epoch_ns("o_orderdate") + F.lit(ORDERS_SHIFT)).alias("scheduled_date_ns"),
            F.expr("CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'COMPLETE' WHEN 'F' THEN 'COMPLETED' END").alias("status"), F.col("o_custkey"),
        )

    @property
    def risks(self) -> DataFrame:
        return self._read("part").selectExpr(
            "concat('RSK-', p_partkey) AS id", "concat('SYS-', p_partkey % 25) AS system_id",
            f"{NOW_NS}L - (340 + cast(p_size AS bigint)) * {NS_PER_DAY}L - CASE WHEN p_partkey % 2 = 0 THEN 3600000000000L ELSE 0L END AS last_review_date_ns",
        )

    @property
    def incidents(self) -> DataFrame:
        k = "cast(get_json_object(props, '$.k') AS int)"
        return self._read("events").select(
            F.expr("concat('INC-', event_id)").alias("id"), F.expr("concat('SYS-', user_id % 25)").alias("system_id"),
            F.expr("CASE event_type WHEN 'error' THEN 'P1' WHEN 'purchase' THEN 'P2' ELSE 'P3' END").alias("severity"), F.expr("CASE WHEN value < 60 THEN 'OPEN' ELSE 'CLOSED' END").alias("status"),
            (epoch_ns("ts") + F.lit(EVENTS_SHIFT)).alias("opened_date_ns"), F.expr(f"CASE {k} % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("rca_started"),
        )

    @property
    def requirements(self) -> DataFrame:
        return self._read("part").selectExpr("concat('URS-', p_partkey) AS id", "concat('SYS-', p_partkey % 25) AS system_id", "p_name AS req_text", "concat('TC-', p_partkey % 120) AS test_case_id")

    @property
    def test_cases(self) -> DataFrame:
        return self._read("supplier").selectExpr("concat('TC-', s_suppkey) AS id", "concat('SYS-', s_suppkey % 25) AS system_id", "CASE WHEN s_acctbal < 3000 THEN 'DRAFT' ELSE 'EXECUTED' END AS status")

    @property
    def suppliers(self) -> DataFrame:
        return self._read("supplier").selectExpr(
            "concat('SUP-', s_suppkey) AS id", "concat('SYS-', s_nationkey) AS system_id", "s_name AS name", f"{NOW_NS}L + (s_suppkey % 61 - 30) * {NS_PER_DAY}L AS reassessment_due_date_ns", "'APPROVED' AS status"
        )

    @property
    def periodic_evaluations(self) -> DataFrame:
        return self._read("customer").selectExpr("concat('PE-', c_custkey) AS id", "concat('SYS-', c_nationkey) AS system_id", f"{NOW_NS}L + (c_custkey % 61 - 30) * {NS_PER_DAY}L AS due_date_ns", "'PENDING' AS status")

    @property
    def access_records(self) -> DataFrame:
        return self._read("customer").selectExpr(
            "concat('ACC-', c_custkey) AS id", "concat('SYS-', c_nationkey) AS system_id", "concat('U-', c_custkey) AS user_id", "c_mktsegment = 'MACHINERY' AS is_privileged",
            "CASE WHEN c_acctbal < 0 THEN 'DEPARTED' ELSE 'ACTIVE' END AS user_status",
        )

    @property
    def changes(self) -> DataFrame:
        return self._orders.selectExpr("concat('CR-', o_orderkey) AS id", "concat('SYS-', c_nationkey) AS system_id", "CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PENDING' END AS status")

    @property
    def change_actions(self) -> DataFrame:
        return self._read("lineitem").selectExpr(
            "concat('CA-', l_orderkey, '-', l_linenumber) AS id", "concat('CR-', l_orderkey) AS change_id", "CASE l_linestatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' END AS status", "l_partkey"
        )

    @property
    def design_elements(self) -> DataFrame:
        return self._read("nation").selectExpr("concat('DE-', n_nationkey) AS id", "concat('SYS-', n_nationkey) AS system_id", "n_name AS description")

    @property
    def test_results(self) -> DataFrame:
        return self._read("lineitem").selectExpr("concat('TR-', l_orderkey, '-', l_linenumber) AS id", "concat('TC-', l_suppkey + 2) AS test_case_id")

    @property
    def supplier_assessments(self) -> DataFrame:
        return self._read("part").selectExpr("concat('SA-', p_partkey) AS id", "concat('SUP-', p_partkey % 120) AS supplier_id")

    @property
    def document_chunks(self) -> DataFrame:
        """A chunk for each labelled document and for some that aren't there."""
        return self._read("labels").selectExpr("concat('CH-', doc_id) AS chunk_id", "concat('DOC-', doc_id * 2) AS document_id")

    @property
    def findings(self) -> DataFrame:
        return self._read("orders").where("o_orderstatus = 'F'").selectExpr("concat('F-', o_orderkey) AS id", "concat('SYS-', o_custkey % 26) AS system_id")

    @property
    def evidence_refs(self) -> DataFrame:
        return self._read("orders").selectExpr("concat('ER-', o_orderkey) AS id", "concat('F-', o_orderkey) AS finding_id")

    @property
    def graph_nodes(self) -> DataFrame:
        parts = [self[t].select(F.col("id").alias("node_id"), "system_id") for t in ("requirements", "test_cases", "risks", "incidents", "documents")]
        return reduce(DataFrame.unionByName, parts)

    @property
    def graph_edges(self) -> DataFrame:
        return self.requirements.selectExpr("id AS source_id", "test_case_id AS target_id", "'VERIFIED_BY' AS relation_type")

    @property
    def users(self) -> DataFrame:
        return self._read("customer").selectExpr("concat('U-', c_custkey) AS id", "c_name AS username")

    @property
    def sessions(self) -> DataFrame:
        return self._read("events").selectExpr("concat('S-', event_id) AS id", "concat('U-', user_id) AS user_id")

    @property
    def action_proposals(self) -> DataFrame:
        kind = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'PROHIBITED' WHEN '2' THEN 'GXP_RELEVANT_WRITE' WHEN '3' THEN 'MOCK_WRITE_LOW_RISK' WHEN '4' THEN 'DRAFT' WHEN '5' THEN 'READ' END"
        return self._read("orders").selectExpr("concat('AP-', o_orderkey) AS id", f"{kind} AS action_type", "concat('U-', o_custkey) AS user_id")

    @property
    def access_grants(self) -> DataFrame:
        """Permissions that users were given in systems: an order is a grant to its customer, by its priority and status."""
        number = "3 * (cast(substring(o_orderpriority, 1, 1) AS int) - 1) + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
        customers = self._read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        names = ", ".join(f"'{p}'" for p in PERMISSIONS)
        return self._read("orders").select("o_custkey", "o_orderpriority", "o_orderstatus").join(customers, "o_custkey").selectExpr("concat('U-', o_custkey) AS user_id", "concat('SYS-', c_nationkey) AS system_id", f"get(array({names}), {number}) AS permission")

    @property
    def audit_log(self) -> DataFrame:
        """Events to be chained, a chain for each user: (chain, ts, event_id, canonical)."""
        from veriframe.functions.expressions import canonical_json

        fields = {
            "action_type": F.col("event_type"), "output_summary": F.expr("cast(cast(round(value * 100) AS bigint) AS string)"),
            "target_record_id": F.expr("concat('INC-', event_id)"), "user_id": F.expr("cast(user_id AS string)"),
        }
        return self._read("events").select(F.col("user_id").alias("chain"), "ts", "event_id", "value", canonical_json(**fields).alias("canonical"))
