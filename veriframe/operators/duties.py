"""Segregation of duties: users who hold permissions that no one may hold together.

Grants are summed to bitmaps, one row a user and system, by ``bit_or`` in the map tasks; conflicts are pairs of bits held
against the bitmap. No grant meets another, so that a user with a third of all grants costs no more than their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Own definition: permissions, and those that exclude each other.
PERMISSIONS = ["CREATE_RECORD", "REVIEW_RECORD", "APPROVE_RECORD", "DEVELOP_CHANGE", "TEST_CHANGE", "DEPLOY_CHANGE", "MANAGE_USERS", "REVIEW_ACCESS", "ADMINISTER_SYSTEM", "REVIEW_AUDIT_TRAIL", "RELEASE_BATCH", "QUALIFY_SUPPLIER", "ORDER_SUPPLY"]
CONFLICTS = [
    ("SOD-01", "CREATE_RECORD", "APPROVE_RECORD"),
    ("SOD-02", "DEVELOP_CHANGE", "DEPLOY_CHANGE"),
    ("SOD-03", "DEVELOP_CHANGE", "TEST_CHANGE"),
    ("SOD-04", "MANAGE_USERS", "REVIEW_ACCESS"),
    ("SOD-05", "ADMINISTER_SYSTEM", "REVIEW_AUDIT_TRAIL"),
    ("SOD-06", "REVIEW_RECORD", "RELEASE_BATCH"),
    ("SOD-07", "QUALIFY_SUPPLIER", "ORDER_SUPPLY"),
]
#: Bits of a bitmap's word.
WORD = 62


def permission_bitmaps(grants: DataFrame, permissions: Sequence[str] = PERMISSIONS) -> DataFrame:
    """``grants`` (user_id, system_id, permission) -> (user_id, system_id, words array<long>): one bit a permission; unknown and null ones have none."""
    known = F.create_map(*[x for i, p in enumerate(permissions) for x in (F.lit(p), F.lit(i))])
    place = grants.select("user_id", "system_id", F.try_element_at(known, F.col("permission")).alias("_i"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i") % WORD)
    words = [F.bit_or(F.when(F.floor(F.col("_i") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(-(-len(permissions) // WORD))]
    return place.groupBy("user_id", "system_id").agg(*words).select("user_id", "system_id", F.array(*[F.coalesce(f"_w{w}", F.lit(0).cast("long")) for w in range(len(words))]).alias("words"))


def duty_conflicts(grants: DataFrame, permissions: Sequence[str] = PERMISSIONS, conflicts: Sequence[tuple[str, str, str]] = CONFLICTS) -> DataFrame:
    """(user_id, system_id, conflict_id, first, second) of every pair that a user holds in a system, once however often it was granted."""
    if lost := {p for _, a, b in conflicts for p in (a, b)} - set(permissions):
        raise ValueError(f"conflicts name unknown permissions: {sorted(lost)}")
    at = {p: divmod(i, WORD) for i, p in enumerate(permissions)}
    held = lambda p: F.col("words")[at[p][0]].bitwiseAND(F.lit(1 << at[p][1]).cast("long")) != 0
    broken = F.array_compact(F.array(*[F.when(held(a) & held(b), F.struct(F.lit(c).alias("conflict_id"), F.lit(a).alias("first"), F.lit(b).alias("second"))) for c, a, b in conflicts]))
    return permission_bitmaps(grants, permissions).select("user_id", "system_id", F.inline(broken))
