"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go; lines that ten or more documents share go; of each group of near duplicates the document with the
smallest id stays; passages of the benchmark are cut out; what is left is mixed to the sources' target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import durable
from veriframe.llm.decontaminate import cut_contamination
from veriframe.llm.line_dedup import drop_frequent_lines
from veriframe.llm.mixing import mix
from veriframe.llm.near_copies import one_of_each
from veriframe.llm.toxicity import THRESHOLD, fit, score_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold, rows as they are.

    Null and empty texts are scored like any other, very long ones by all their windows; repeated rows get one score and stay or go together.
    Columns beside COLUMNS go, whatever their names. An empty table stays empty; without labels nothing goes.
    """
    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs.select(*COLUMNS), model).where(F.col("_score") < THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more rows hold; ``n_chars`` follows the text.

    Null texts become empty; empty lines stay. Repeated rows count each. Very long texts are read whole. Columns beside COLUMNS go. An empty table stays empty.
    """
    kept = drop_frequent_lines(docs.select(*COLUMNS))
    return kept.withColumn("text", F.col("_kept")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are similar by 0.8 or more, one document: a row of the smallest id.

    Rows that repeat an id, and rows without one, are told apart by their texts: of those in one component one stays. All null and blank
    texts are one component. Very long texts are compared whole. Columns beside COLUMNS go. An empty table stays empty.
    """
    return one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages of the benchmark cut out of those that hold any; ``n_chars`` follows the text.

    Null and empty texts stay as they are (null: ``n_chars`` null). Very long texts are searched whole, repeated rows each. Columns beside COLUMNS go. An empty table
    stays empty; an empty benchmark cuts nothing.
    """
    clean = cut_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document, numbered from 1; documents that the mix doesn't take have none.

    Null and empty texts have no words and are never taken. Repeated rows are taken each for itself. Columns beside COLUMNS go. An empty table stays empty.
    """
    taken = mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars")).where(F.col("copies") > 0)
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: A trained network scores the first stage, so SQL can't express the whole; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
