"""A keyed table of chunks that is brought up to date by content: only buckets in which something changed are written again.

Data lie in folders by version and bucket, and a manifest of one small file a version says which folder each bucket is read from. A
version is there once its manifest is; a write that fails before that leaves the last one as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "doc_id long, chunk_index int, content string, content_hash string, deleted_in long"
MANIFEST = "version long, bucket long, path string"


class ChunkStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.buckets)).cast("long")

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The version (0: nothing yet) and each bucket's folder: as many rows as buckets."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException:
            return 0, {}
        version = rows.agg(F.max("version")).first()[0]
        if version is None:  # a first write that failed
            return 0, {}
        return version, {r.bucket: r.path for r in rows.where(F.col("version") == version).collect()}

    def _rows(self) -> DataFrame:
        _, paths = self.manifest()
        return self.spark.read.schema(ROWS).parquet(*sorted(paths.values())) if paths else self.spark.createDataFrame([], ROWS)

    def table(self) -> DataFrame:
        """(doc_id, chunk_index, content, content_hash) of the current version."""
        return self._rows().where("deleted_in IS NULL").drop("deleted_in")

    def tombstones(self) -> DataFrame:
        """(doc_id, chunk_index, deleted_in): chunks that are gone, and the version in which they went."""
        return self._rows().where("deleted_in IS NOT NULL").select("doc_id", "chunk_index", "deleted_in")

    def upsert(self, chunks: DataFrame) -> dict[str, int]:
        """Makes ``chunks`` (doc_id, chunk_index, content), one row a key, the current version; numbers of chunks inserted, changed, deleted and left as they were, and of buckets written. Without a change nothing is written. Changes are told by content hash; contents of untouched buckets are neither shuffled nor read."""
        version, paths = self.manifest()
        new = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("content").cast("string").alias("content"))
        new = new.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).withColumn("bucket", self._bucket())
        key = ["bucket", "doc_id", "chunk_index"]
        held = self._rows().withColumn("bucket", self._bucket())
        before = held.where("deleted_in IS NULL").select(*key, F.col("content_hash").alias("_was"))
        met = new.select(*key, F.col("content_hash").alias("_is")).join(before, key, "full")
        change = F.when(F.col("_was").isNull(), "inserted").when(F.col("_is").isNull(), "deleted").when(F.col("_is") != F.col("_was"), "changed").otherwise("same")
        counts = met.groupBy("bucket", change.alias("change")).count().collect()  # four rows a bucket at most
        touched = sorted({r.bucket for r in counts if r.change != "same"})
        summary = {c: sum(r["count"] for r in counts if r.change == c) for c in ("inserted", "changed", "deleted", "same")} | {"buckets": len(touched)}
        if not touched:
            return summary
        alive = new.where(F.col("bucket").isin(touched)).withColumn("deleted_in", F.lit(None).cast("long"))
        gone = held.where(F.col("bucket").isin(touched)).join(new.select(*key), key, "left_anti").withColumn("deleted_in", F.coalesce("deleted_in", F.lit(version + 1))).withColumn("content", F.lit(None).cast("string"))
        rows = alive.unionByName(gone).repartition(min(len(touched), 200), "bucket").sortWithinPartitions("bucket", "doc_id", "chunk_index")
        path = f"{self.folder}/data/v{version + 1}"
        rows.write.partitionBy("bucket").mode("overwrite").parquet(path)
        paths |= {b: f"{path}/bucket={b}" for b in touched}
        self.spark.createDataFrame([(version + 1, b, p) for b, p in sorted(paths.items())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return summary
