"""Keyed writes as plans: insert if absent, and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str | list[str] = "id", order: Column | None = None) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key, of one column or several, it lacks; of new rows with one key the first by ``order`` (or any)."""
    key = [key] if isinstance(key, str) else key
    absent = new.join(existing.select(*key), key, "left_anti").select(*existing.columns, *([order.alias("_order")] if order is not None else []))
    if order is None:
        return existing.unionByName(absent.dropDuplicates(key))
    first = absent.groupBy(*key).agg(F.min_by(F.struct(*existing.columns), "_order").alias("_row")).select("_row.*")
    return existing.unionByName(first)


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of all rows with one key the last by ``order``; a row of ``new`` wins a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*existing.columns), F.struct(order, "_new")).alias("_row")).select("_row.*")


def last_write_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")
