"""Frequent-line removal over levelled sorted runs of line hashes; DataFrame functions only.

A run is a table (key, docs), sorted by the 128-bit key, of how many documents of some batches hold a line. Batches
come one after another. A batch merge-anti-joins the *settled* runs, of keys already known to be in enough documents;
of what is left, keys that the batch alone has often enough become a settled run, the others a run of level 0. When a
level has ``fanout`` runs they are compacted into one run of the next level, and keys whose sum reaches the bound there
become a settled run too. At the end all runs are merged once. Counts only ever add up, so the answer does not depend on
batches or fanout; what the anti-join saves is that a line of a third of all documents is settled by the first batch.

Runs are kept in buckets of the key, each sorted, so that neither the anti-join nor a compaction shuffles: Spark reads
bucket k of each run in one task and merges there. It sorts a bucket again, in memory, because it takes a bucket's order
for granted only under a setting of older releases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import LOWER, SPACES, UPPER, bucketed, durable, maybe_broadcast, text_or_empty

#: A fixed number of batches for a table that is given whole; a caller with batches of its own adds them to LineRuns. Twice the fanout: there are two compactions, and all batches but the first are anti-joined.
BATCHES, FANOUT = 6, 3
#: Keys of a bucket on average (24 bytes each); the number of buckets follows the table.
BUCKET_KEYS = 2_000_000
#: Frequent keys, and words of dropped line numbers, that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def keys_of(text: Column) -> Column:
    """The lines of ``text`` as keys: A-Z lower-cased, stripped of white space at both ends; kept in order."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda x: F.trim(x, F.lit(SPACES)))


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


class LineRuns:
    """The runs: levels of bucketed tables, and those of settled keys."""

    def __init__(self, min_docs: int, fanout: int = FANOUT, buckets: int = 1) -> None:
        self.min_docs, self.fanout, self.buckets = min_docs, fanout, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _kept(self, run: DataFrame) -> DataFrame:
        return bucketed(run, "line-run", self.buckets, ("a", "b"), placed=True)

    def _split(self, run: DataFrame) -> DataFrame:
        """``run``, a kept one, without its frequent keys; those become a settled run."""
        often = F.col("docs") >= self.min_docs
        if not (done := run.where(often).select("a", "b")).isEmpty():
            self.settled.append(self._kept(done))
        return run.where(~often)

    def add(self, batch: DataFrame) -> None:
        """``batch``: (a, b, docs), one row for each key of the batch, in the runs' buckets."""
        new = reduce(lambda rest, run: rest.hint("merge").join(run, ["a", "b"], "left_anti"), self.settled, batch)
        self.levels[0].append(self._split(self._kept(new)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            whole = self._kept(self._merged(self.levels[level]))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._split(whole))
            level += 1
        if len(self.settled) >= self.fanout:
            self.settled = [self._kept(reduce(DataFrame.unionByName, self.settled).groupBy("a", "b").agg(F.lit(0).alias("_")).select("a", "b"))]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("a", "b").agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame:
        """(a, b) of the keys in at least ``min_docs`` documents."""
        open_runs = [r for level in self.levels for r in level]
        found = [*self.settled]
        if open_runs:
            found.append(self._merged(open_runs).where(F.col("docs") >= self.min_docs).select("a", "b"))
        return reduce(DataFrame.unionByName, found).distinct()  # what earlier runs hold of a settled key can reach the bound too


def line_runs(docs: DataFrame, min_docs: int, batches: int = BATCHES) -> LineRuns:
    """The runs of the line keys, not empty, of ``docs``. One scan hashes the lines and sums them by batch and key; the batches are slices of that table."""
    lines = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), F.explode(F.array_distinct(keys_of(text_or_empty()))).alias("k")).where("k != ''")
    sums = lines.select("batch", hashed(F.col("k")).alias("h")).groupBy("batch", "h.a", "h.b").agg(F.count("*").alias("docs"))
    sums = durable(sums, "line-sums")
    buckets = max(1, -(-sums.count() // BUCKET_KEYS), docs.sparkSession.sparkContext.defaultParallelism)
    table = bucketed(sums, "line-batches", buckets, ("a", "b"), partition_by=("batch",))
    runs = LineRuns(min_docs, buckets=buckets)
    for batch in range(batches):
        runs.add(table.where(F.col("batch") == batch).select("a", "b", "docs"))
    return runs


def frequent_lines(docs: DataFrame, min_docs: int, batches: int = BATCHES) -> DataFrame:
    """(a, b) of the line keys, not empty, in at least ``min_docs`` rows of ``docs``."""
    return durable(line_runs(docs, min_docs, batches).frequent(), "line-frequent")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` -> all its columns with ``_n_lines``, ``_n_dropped`` and ``_kept``, the text without frequent lines.

    Input columns with those three names are replaced. Null and empty texts are one empty line. Empty lines are never dropped. Every row counts as a document, repeated
    rows too. A document's dropped lines are found as a bit set of 64 line numbers a word, so that a document of very
    many lines stays a small row. An empty table gives an empty result.
    """
    frequent = maybe_broadcast(frequent_lines(docs, min_docs), broadcast_keys)
    place = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), F.posexplode(keys_of(text_or_empty())).alias("_pos", "_k")).where("_k != ''")
    hit = place.select("_id", "_t", "_pos", hashed(F.col("_k")).alias("h")).select("_id", "_t", "_pos", "h.a", "h.b").join(frequent, ["a", "b"], "left_semi")
    words = hit.groupBy("_id", "_t", F.expr("_pos div 64").cast("int").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits"))
    drops = words.groupBy("_id", "_t").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_drop"), F.sum(F.bit_count("_bits")).cast("long").alias("_n_dropped"))
    drops = durable(drops, "line-drops")
    out = ("_n_lines", "_n_dropped", "_kept")
    mine = docs.select(F.struct(*[c for c in docs.columns if c not in out]).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_x"))
    small = (drops.agg(F.sum(F.size("_drop"))).first()[0] or 0) <= broadcast_keys  # by entries, not rows: a text of very many lines has a long map
    joined = mine.join(F.broadcast(drops) if small else drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_t")), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    kept = F.filter(lines, lambda x, i: F.coalesce(F.expr("_drop")[F.floor(i / 64).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))), F.lit(0)) == 0)
    return (
        joined.withColumn("_n_lines", F.size(lines).cast("long"))
        .withColumn("_n_dropped", F.coalesce("_n_dropped", F.lit(0)).cast("long"))
        .withColumn("_kept", F.when(F.col("_drop").isNull(), text_or_empty()).otherwise(F.array_join(kept, "\n")))
        .select("_row.*", *out)
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = drop_frequent_lines(docs)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE_OP4 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, i, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
