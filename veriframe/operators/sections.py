"""Sections of documents as nested intervals, and the section that a retrieved chunk belongs to.

A heading's section goes on to the next heading of its level or a higher one. Of the sections that hold a place the smallest
is that of the last heading before it, so that the interval join is a search for the heading before, over the headings and
hits of the hits' documents only. Texts stay where they are until the sections of the hits are cut from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Own definition of a heading's level: marks (1-6), the parts of its number (1-6), or 7 for a short line that starts with a capital and doesn't end as a sentence.
LEVELS, SHORT = 7, 60
MARKED, NUMBERED = r"^(#{1,6})[ \t]+[^ \t]", r"^([0-9]{1,3}(?:\.[0-9]{1,3}){0,5})\.?[ \t]+[^ \t0-9]"


def headings(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, start, end, level, title): start and end in characters, from 0, end exclusive; null texts have none."""
    lines = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_i", "_l"))
    line = F.rtrim("_l")
    marks = F.char_length(F.regexp_extract("_l", MARKED, 1))
    number = F.regexp_extract("_l", NUMBERED, 1)
    ends = line.rlike(r"[.,;:!?|]$")
    level = F.when(marks > 0, marks).when((number != "") & ~ends & (F.char_length(line) <= 2 * SHORT), F.least(F.size(F.split(number, r"\.")), F.lit(6))).when(line.rlike(r"^[A-Z]") & ~ends & (F.char_length(line) <= SHORT), F.lit(LEVELS))
    rows = lines.select("doc_id", "_i", F.char_length("_l").alias("_n"), level.alias("level"), F.when(level.isNotNull(), F.trim(F.regexp_replace("_l", r"^#+", ""))).alias("title"))
    w = Window.partitionBy("doc_id").orderBy("_i")  # numbers of one text's lines
    placed = rows.withColumn("start", F.coalesce(F.sum(F.col("_n") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("_whole", F.sum(F.col("_n") + 1).over(Window.partitionBy("doc_id")) - 1).where("level IS NOT NULL")
    after = Window.partitionBy("doc_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    following = F.array(*[F.min(F.when(F.col("level") <= n, F.col("start"))).over(after) for n in range(1, LEVELS + 1)])
    return placed.withColumn("_f", following).select("doc_id", "start", F.coalesce(F.get("_f", F.col("level") - 1), "_whole").alias("end"), "level", "title")


def parent_sections(hits: DataFrame, docs: DataFrame, step: int) -> DataFrame:
    """``hits`` (doc_id, chunk_index, ...) with the smallest section that holds the chunk's first character (chunk_index * ``step``): (level, title, start, end, section). Before the first heading it is the whole text, of level 0."""
    key = ["doc_id", "chunk_index"]
    asked = hits.select(*key).distinct()
    texts = docs.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    marks = headings(texts).select("doc_id", F.col("start").alias("_at"), F.struct("start", "end", "level", "title").alias("_s"))
    places = asked.select(*key, (F.col("chunk_index") * step).cast("long").alias("_at"))
    w = Window.partitionBy("doc_id").orderBy("_at", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(places, allowMissingColumns=True).withColumn("_of", F.last("_s", ignorenulls=True).over(w)).where("chunk_index IS NOT NULL").select(*key, "_of")
    start, end = F.coalesce("_of.start", F.lit(0).cast("long")), F.coalesce("_of.end", F.char_length("text").cast("long"))
    cut = met.join(texts, "doc_id").select(*key, F.coalesce("_of.level", F.lit(0)).alias("level"), F.coalesce("_of.title", F.lit("")).alias("title"), start.alias("start"), end.alias("end"), F.substring("text", (start + 1).cast("int"), (end - start).cast("int")).alias("section"))
    return hits.join(cut, key)
