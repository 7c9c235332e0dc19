"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.runtime import shared_folder, table_name

#: The white space of all contracts, ``[\x20\x09-\x0D]``, as characters.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def durable(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: tuple[str, ...], partition_by: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``by``, each sorted, and read again: joins and sums by ``by`` of such tables with as many buckets need no shuffle. ``placed``: ``df`` comes from such tables."""
    spark = df.sparkSession
    table = table_name(spark, name)
    writer = (df if placed else df.repartition(buckets, *by)).write.bucketBy(buckets, *by).sortBy(*by).option("path", shared_folder(spark, name))
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    return spark.table(table)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a durable table has at most ``max_rows`` rows; the check before each broadcast."""
    return df.count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted size is within ``max_rows``; as it is (a shuffle join) beyond that."""
    return F.broadcast(df) if fits(df, max_rows) else df


def with_ids(docs: DataFrame, ids: DataFrame, max_rows: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, ...) whose id is in ``ids`` (id long; a null stands for rows without one).

    Ids are sent to the rows as bits, 64 neighbours a word, so that texts are not shuffled. Where ids lie so far apart that they have more than ``max_rows`` words, both sides are.
    """
    of = F.col("doc_id").cast("long")
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    words = durable(ids.groupBy(F.shiftright("id", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "id-words")
    if not fits(words, max_rows):
        return docs.join(ids.select(F.col("id").alias("_id")), of.eqNullSafe(F.col("_id")), "left_semi")
    held = F.col("_bits").isNull() | (F.getbit("_bits", of.bitwiseAND(63).cast("int")) == 1)  # no bits: the word of the null
    return docs.join(F.broadcast(words), F.shiftright(of, 6).eqNullSafe(F.col("_word")) & held, "left_semi")


#: Rows that a task holds as Python objects at once.
SLICE = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows: long texts are then Python objects a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


#: Rows of an Arrow batch of texts, where the session leaves Spark's default of 10,000.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session then sends texts to Python in batches of BATCH_ROWS, unless it has a number of its own: buffers of 10,000 long texts take hundreds of MB."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
