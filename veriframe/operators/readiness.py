"""Readiness scores, matrices and registries over violations and records."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.clock import NS_PER_DAY
from veriframe.operators.policies import RULES

Tables = Mapping[str, DataFrame]
#: Fixed values: (dimension, weight); the tables and rules of each are our own choice, as is a dimension's score, 100 less the share of violating records.
WEIGHTS = [("documentation", 0.25), ("access", 0.20), ("risk", 0.20), ("incidents", 0.15), ("change", 0.12), ("urs", 0.08)]
TABLES_OF = {"documentation": ["documents"], "access": ["access_reviews", "access_records"], "risk": ["risks"], "incidents": ["incidents"], "change": ["changes"], "urs": ["requirements"]}
RULES_OF = {"documentation": [1], "access": [2, 9], "risk": [3], "incidents": [4], "change": [10], "urs": [5]}
CAPA_DAYS = 30


def readiness(t: Tables, violations: DataFrame) -> DataFrame:
    """(system_id, readiness): the weighted dimensions; a dimension without records scores 100."""
    totals = reduce(DataFrame.unionByName, (t[name].groupBy("system_id").agg(F.count("*").alias("n")).select("system_id", F.lit(d).alias("dimension"), "n", F.lit(0).cast("long").alias("v")) for d, names in TABLES_OF.items() for name in names))
    of_rule = {RULES[n - 1][0]: d for d, numbers in RULES_OF.items() for n in numbers}
    dimension = F.lit(None).cast("string")
    for rule, d in of_rule.items():
        dimension = F.when(F.col("rule_id") == rule, d).otherwise(dimension)
    gaps = violations.select("system_id", dimension.alias("dimension")).where("dimension IS NOT NULL").groupBy("system_id", "dimension").agg(F.count("*").alias("v")).select("system_id", "dimension", F.lit(0).cast("long").alias("n"), "v")
    scores = totals.unionByName(gaps).groupBy("system_id").agg(*[F.sum(F.when(F.col("dimension") == d, F.col(c))).alias(f"{c}_{d}") for d, _ in WEIGHTS for c in ("n", "v")])
    part = lambda d: F.coalesce(100.0 * (1 - F.coalesce(f"v_{d}", F.lit(0)) / F.nullif(f"n_{d}", F.lit(0))), F.lit(100.0))
    total = reduce(lambda a, b: a + b, (w * part(d) for d, w in WEIGHTS))
    return t["gxp_systems"].select(F.col("id").alias("system_id")).join(scores, "system_id", "left").select("system_id", F.round(total, 4).alias("readiness"))


def gap_matrix(violations: DataFrame) -> DataFrame:
    """(system_id, p1 .. p10): violations of each rule."""
    return violations.groupBy("system_id").agg(*[F.count_if(F.col("rule_id") == r[0]).alias(f"p{k + 1}") for k, r in enumerate(RULES)])


def evidence_heat_map(t: Tables) -> DataFrame:
    """(system_id, n_executed, n_draft, n_missing) of requirements by their test case."""
    cases = t["test_cases"].select(F.col("id").alias("test_case_id"), F.col("status").alias("case_status"))
    rows = t["requirements"].join(cases, "test_case_id", "left")
    return rows.groupBy("system_id").agg(F.count_if(F.col("case_status") == "EXECUTED").alias("n_executed"), F.count_if(F.col("case_status") == "DRAFT").alias("n_draft"), F.count_if(F.col("case_status").isNull()).alias("n_missing"))


def supplier_registry(t: Tables, now_ns: int) -> DataFrame:
    late = F.lit(now_ns) - F.col("reassessment_due_date_ns")
    return t["suppliers"].select("id", "name", "system_id", "status", F.coalesce(late > 0, F.lit(False)).alias("overdue"), F.greatest(F.floor(late / NS_PER_DAY), F.lit(0)).cast("long").alias("days_overdue"))


def health_cards(t: Tables, violations: DataFrame) -> DataFrame:
    """(system_id, n_critical, n_high, n_medium) of every system."""
    counts = violations.groupBy("system_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM")])
    return t["gxp_systems"].select(F.col("id").alias("system_id")).join(counts, "system_id", "left").na.fill(0)


def capa_candidates(violations: DataFrame, now_ns: int) -> DataFrame:
    """High and critical gaps with the day that their action is due."""
    due = F.date_add(F.date_from_unix_date(F.lit(now_ns // NS_PER_DAY).cast("int")), CAPA_DAYS)
    return violations.where(F.col("severity").isin("HIGH", "CRITICAL")).select("rule_id", "system_id", "record_id", "severity", due.alias("due_date"))


def risk_score(risks: DataFrame, rubric: dict[str, int], probabilities: dict[str, int]) -> DataFrame:
    """``risks`` (severity, probability, ...) with ``risk_score``, their product under the given rubric; null if either is unknown."""

    def points(column: str, table: dict[str, int]):
        out = F.lit(None).cast("int")
        for name, value in table.items():
            out = F.when(F.col(column) == name, value).otherwise(out)
        return out

    return risks.withColumn("risk_score", points("severity", rubric) * points("probability", probabilities))
