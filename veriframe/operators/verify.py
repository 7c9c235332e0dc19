"""Findings held against their source records and the violations, and graded.

All policies are evaluated once; a finding is corroborated if a violation of its first citation's rule names one of its
evidence ids, and its record is found if the table of that rule holds its first evidence id. The evidence tables are
reduced to the ids that findings ask for by one semi-join over a tagged union.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.expressions import confidence, true_count
from veriframe.functions.runtime import checkpointed
from veriframe.operators.policies import EVIDENCE


def evidence_ids(t: Mapping[str, DataFrame]) -> DataFrame:
    """(rule_id, record_id) of every record that can be evidence."""
    return reduce(DataFrame.unionByName, (t[name].select(F.lit(rule).alias("rule_id"), F.col("id").alias("record_id")) for rule, name in EVIDENCE.items()))


def verify_findings(findings: DataFrame, violations: DataFrame, t: Mapping[str, DataFrame]) -> DataFrame:
    """Each finding with db_record_found, opa_corroborated, opa_rule_ids and confidence. No findings, no rows; of findings with one id the last by claim stays."""
    once = findings.groupBy("finding_id", "system_id").agg(F.max_by(F.struct("regulatory_citations", "evidence_ids", "alcoa_score"), F.coalesce("claim", F.lit(""))).alias("_f"))
    once = checkpointed(once)  # read three times below
    asked = once.select("finding_id", "system_id", "_f.*").withColumn("rule_id", F.try_element_at("regulatory_citations", F.lit(1))).withColumn("first_id", F.try_element_at("evidence_ids", F.lit(1)))
    wanted = asked.select("rule_id", F.col("first_id").alias("record_id"))
    found = evidence_ids(t).join(wanted, ["rule_id", "record_id"], "left_semi").distinct().select("rule_id", F.col("record_id").alias("first_id"), F.lit(True).alias("_found"))
    named = asked.select("finding_id", "system_id", "rule_id", F.explode("evidence_ids").alias("record_id"))
    backed = named.join(violations.select("rule_id", "record_id"), ["rule_id", "record_id"], "left_semi").select("finding_id", "system_id", F.lit(True).alias("_backed")).distinct()
    joined = asked.join(found, ["rule_id", "first_id"], "left").join(backed, ["finding_id", "system_id"], "left")
    record, backing = F.coalesce("_found", F.lit(False)), F.coalesce("_found", F.lit(False)) & F.coalesce("_backed", F.lit(False))
    return joined.select(
        "finding_id", "system_id", confidence(true_count(F.col("alcoa_score")), record, backing).alias("confidence"), record.alias("db_record_found"), backing.alias("opa_corroborated"),
        F.when(backing, F.array("rule_id")).otherwise(F.array().cast("array<string>")).alias("opa_rule_ids"), "evidence_ids",
    )


def verification_view(verified: DataFrame) -> DataFrame:
    """Own definition of the outcome: a violation if corroborated, verified if only the record stands, else insufficient."""
    outcome = F.when(F.col("opa_corroborated"), "VIOLATION").when(F.col("db_record_found"), "VERIFIED").otherwise("INSUFFICIENT EVIDENCE")
    return verified.withColumn("outcome", outcome)
