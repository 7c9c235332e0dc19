"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nine record-integrity flags with their defaults.
ALCOA_DEFAULTS = {
    "attributable": False, "legible": True, "contemporaneous": False, "original": False, "accurate": True,
    "complete": True, "consistent": True, "enduring": True, "available": True,
}
#: Phrases that mark a prompt injection, in any case.
INJECTION_PHRASES = ("ignore previous instructions", "override system prompt", "disregard rules")


def alcoa_map(values: dict[str, bool] = ALCOA_DEFAULTS) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def true_count(flags: Column) -> Column:
    """True values of a map of booleans; a null or empty map has none."""
    return F.coalesce(F.aggregate(F.map_values(flags), F.lit(0), lambda n, v: n + F.coalesce(v, F.lit(False)).cast("int")), F.lit(0))


def confidence_score(trues: Column, corroborated: Column) -> Column:
    """100, less 10 for each flag of nine that isn't true, less 100 without corroboration."""
    return 100 - (9 - trues) * 10 - F.when(corroborated, 0).otherwise(100)


def confidence(trues: Column, found: Column, corroborated: Column) -> Column:
    """HIGH above 80, MEDIUM from 50, LOW above 0, else INSUFFICIENT_EVIDENCE, as without a record."""
    score = confidence_score(trues, corroborated)
    return F.when(~F.coalesce(found, F.lit(False)), "INSUFFICIENT_EVIDENCE").when(score > 80, "HIGH").when(score >= 50, "MEDIUM").when(score > 0, "LOW").otherwise("INSUFFICIENT_EVIDENCE")


def injected(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)(" + "|".join(INJECTION_PHRASES) + ")"), F.lit(False))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for null and empty. No row leaves its place: one fold over the sorted characters sums k log2 k over the lengths k of their runs."""
    n = F.char_length(text)
    weight = lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0)
    state = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("total"))
    start = state(F.lit("").cast("string"), F.lit(0.0), F.lit(0.0))
    step = lambda s, c: F.when(c == s["last"], state(c, s["run"] + 1.0, s["total"])).otherwise(state(c, F.lit(1.0), s["total"] + weight(s["run"])))
    # The sort stands outside the fold's functions, so that it runs once a text.
    total = F.aggregate(F.sort_array(F.filter(F.split(text, ""), lambda c: c != "")), start, step, lambda s: s["total"] + weight(s["run"]))
    return F.when(n > 0, F.greatest(F.log2(n) - total / n, F.lit(0.0)) + 0.0).otherwise(0.0)


def canonical_json(**fields: Column) -> Column:
    """The fields as JSON in order of their names, nulls written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
