"""Admission and routing: roles, injected prompts, classified intents, providers, proposed actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
PERMISSIONS = {"IT System Manager": ["A1", "A2", "A3", "A4", "A5", "A6", "A7"], "QA/Compliance": ["A1", "A2", "A3", "A4", "A5", "A6"], "Auditor": ["A1", "A2"]}
AGENTS = ["A1", "A2", "A3", "A4", "A5", "A6", "A7"]
ROUTABLE = AGENTS[:6]
FALLBACK_INTENT = "unclassified_fallback"
PROVIDERS = {
    "orchestrator": "gemini_flash_thinking", "synthesis": "gemini_flash_thinking", "remediation": "gemini_flash_thinking",
    "compliance": "gemini_flash_fast", "knowledge": "gemini_flash_fast", "change": "gemini_flash_fast",
    "risk_assessment": "deepseek_r1", "incident": "groq_llama", "access": "groq_llama", "high_volume": "groq_llama", "fallback": "openrouter_fallback",
}
#: Fixed values: (decision, status) of each kind of action.
ACTIONS = {
    "READ": ("AUTO", "EXECUTED"), "DRAFT": ("AUTO", "EXECUTED"), "MOCK_WRITE_LOW_RISK": ("QUEUE", "PENDING"), "GXP_RELEVANT_WRITE": ("BLOCK", "BLOCKED"), "PROHIBITED": ("BLOCK", "BLOCKED"),
}


def rbac_matrix(spark: SparkSession) -> DataFrame:
    """(role, agent, allowed) of every role and agent."""
    roles = spark.createDataFrame(list(PERMISSIONS.items()), "role string, agents array<string>")
    return roles.select("role", "agents", F.explode(F.array(*map(F.lit, AGENTS))).alias("agent")).select("role", "agent", F.array_contains("agents", F.col("agent")).alias("allowed"))


def authorize(requests: DataFrame) -> DataFrame:
    """``requests`` (role, agent, ...) with ``allowed``; unknown roles and agents, and nulls, are refused."""
    allowed = F.lit(False)
    for role, agents in PERMISSIONS.items():
        allowed = F.when(F.col("role") == role, F.coalesce(F.col("agent").isin(agents), F.lit(False))).otherwise(allowed)
    return requests.withColumn("allowed", allowed)


def route_actions(proposals: DataFrame) -> DataFrame:
    """``proposals`` (action_type, ...) with ``decision`` and ``status``; unknown kinds are blocked."""
    decision, status = F.lit("BLOCK"), F.lit("BLOCKED")
    for kind, (d, s) in ACTIONS.items():
        decision, status = F.when(F.col("action_type") == kind, d).otherwise(decision), F.when(F.col("action_type") == kind, s).otherwise(status)
    return proposals.withColumn("decision", decision).withColumn("status", status)


def validate_routes(responses: DataFrame) -> DataFrame:
    """``responses`` (raw, ...) with ``valid``, ``active_agents`` and ``intent_category``.

    Valid is a JSON object with a non-empty list of known agents and an intent. Anything else, null too, activates all six
    under the fallback intent.
    """
    parsed = F.from_json("raw", "active_agents array<string>, intent_category string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = responses.withColumn("_p", parsed)
    agents = F.col("_p.active_agents")
    known = F.forall(agents, lambda a: F.coalesce(a.isin(ROUTABLE), F.lit(False)))
    valid = F.coalesce(F.col("_p._bad").isNull() & (F.size(agents) > 0) & known & F.col("_p.intent_category").isNotNull(), F.lit(False))
    rows = rows.withColumn("valid", valid)
    every = F.array(*map(F.lit, ROUTABLE))
    return rows.withColumn("active_agents", F.when(F.col("valid"), agents).otherwise(every)).withColumn("intent_category", F.when(F.col("valid"), F.col("_p.intent_category")).otherwise(FALLBACK_INTENT)).drop("_p")


def select_providers(tasks: DataFrame) -> DataFrame:
    """``tasks`` (task, ...) with ``provider`` and ``known``; an unknown task is a row of a gate, not an error."""
    provider = F.lit(None).cast("string")
    for task, name in PROVIDERS.items():
        provider = F.when(F.col("task") == task, name).otherwise(provider)
    return tasks.withColumn("provider", provider).withColumn("known", F.col("provider").isNotNull())


#: Fixed value: the provider that a failed call goes on to, once.
FALLBACK_PROVIDER = "openrouter_fallback"


def cascade(calls: DataFrame) -> DataFrame:
    """``calls`` (provider, outcome, fallback_outcome, ...) with ``answered_by``, ``degraded`` and ``failure_reason``.

    Outcomes are ``ok``, ``missing_key``, ``timeout`` or ``http_`` and a status. A missing key, a timeout, 429 and 5xx go on to the
    fallback, once, unless it was the provider; every other failure (another status, an unknown outcome, null) is degraded at
    once, and so is a call without a provider. Nothing raises.
    """
    first, second = F.coalesce("outcome", F.lit("unknown")), F.coalesce("fallback_outcome", F.lit("unknown"))
    status = F.try_to_number(F.regexp_extract(first, r"^http_(\d{3})$", 1), F.lit("999"))
    goes_on = (first.isin("missing_key", "timeout") | F.coalesce((status == 429) | (status >= 500), F.lit(False))) & (F.col("provider") != FALLBACK_PROVIDER)
    reason = F.concat(first, F.lit(":"), "provider")
    answered = F.when((first == "ok") & F.col("provider").isNotNull(), F.col("provider")).when(goes_on & (second == "ok"), FALLBACK_PROVIDER)
    why = F.when(F.col("provider").isNull(), "unknown_task").when(goes_on, F.concat(reason, F.lit(";"), second, F.lit(f":{FALLBACK_PROVIDER}"))).otherwise(reason)
    done = calls.withColumn("answered_by", answered)
    return done.withColumn("degraded", F.col("answered_by").isNull()).withColumn("failure_reason", F.when(F.col("answered_by").isNull(), why))
