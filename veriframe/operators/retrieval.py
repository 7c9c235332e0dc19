"""Documents in overlapping chunks, ranked by vectors, by BM25, and by both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.expressions import true_count
from veriframe.functions.runtime import checkpointed
from veriframe.operators.reconcile import event_sequence, reconcile

#: Characters of a chunk and of its overlap.
CHUNK, OVERLAP = 512, 64
#: Own choice of the ranking constants; candidates of each list, and what the fused list keeps.
K1, B, RRF_K, CANDIDATES, KEEP = 1.2, 0.75, 60, 20, 8


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, chunk_index, content). Null and empty texts have none; the last may lie inside the one before."""
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("an overlap of more than half a chunk")
    # One pass over the text: blocks of a step, each with the beginning of the next.
    blocks = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_b"))
    parts = F.transform("_b", lambda b, i: F.concat(b, F.substring(F.coalesce(F.get("_b", i + 1), F.lit("")), 1, overlap)))
    return blocks.select("doc_id", F.posexplode(parts).alias("chunk_index", "content"))


def alcoa_prescore(documents: DataFrame) -> DataFrame:
    """(id, attributable, contemporaneous, original): an author (not empty), a date, and no copy."""
    return documents.select(
        "id", (F.coalesce("author", F.lit("")) != "").alias("attributable"), F.col("created_date").isNotNull().alias("contemporaneous"), (~F.coalesce("is_copy", F.lit(False))).alias("original")
    )


def alcoa_extended(documents: DataFrame, systems: DataFrame, source: DataFrame, archive: DataFrame, events: DataFrame) -> DataFrame:
    """(id, n_true, failed, outcome), own definition of the nine dimensions: VERIFIED if all hold, else FAIL, or INSUFFICIENT under five; ``failed`` names those that don't.

    Accurate: the size on record is that of ``source`` (id, n_chars). Enduring: ``archive`` (id) holds it. Consistent: its system is known and its ``events``
    (subject, seq, at) are in order; contemporaneous: dated, as all of them are.
    """
    known = systems.select(F.col("id").alias("system_id"), F.lit(True).alias("_known"))
    wrong = reconcile(documents, source, "id", ["n_chars"]).where("outcome <> 'extra'").select("id", F.lit(True).alias("_wrong"))
    lost = reconcile(documents, archive, "id", []).where("outcome = 'lost'").select("id", F.lit(True).alias("_lost"))
    order = event_sequence(events).select(F.col("subject").alias("id"), "n_undated", "n_out_of_order")
    rows = documents.join(known, "system_id", "left").join(wrong, "id", "left").join(lost, "id", "left").join(order, "id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    flags = {
        "attributable": F.coalesce("author", F.lit("")) != "", "legible": F.col("doc_type").isNotNull(), "contemporaneous": F.col("created_date").isNotNull() & none("n_undated"), "original": ~F.coalesce("is_copy", F.lit(False)),
        "accurate": F.col("_wrong").isNull(), "complete": F.col("author").isNotNull() & F.col("status").isNotNull(),
        "consistent": F.coalesce("_known", F.lit(False)) & none("n_out_of_order"), "enduring": F.col("_lost").isNull(), "available": F.col("id").isNotNull(),
    }
    failed = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in flags.items()]))
    scored = rows.select("id", true_count(F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), v)])).alias("n_true"), F.array_join(failed, ",").alias("failed"))
    return scored.withColumn("outcome", F.when(F.col("n_true") == 9, "VERIFIED").when(F.col("n_true") >= 5, "FAIL").otherwise("INSUFFICIENT"))


def cosine(vector: Column, query: list[float]) -> Column:
    """In doubles; 0 for a null vector or one of no length."""
    q = F.array(*map(F.lit, map(float, query)))
    double = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(double, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x)) * math.sqrt(sum(x * x for x in query))
    return F.coalesce(F.when(norm > 0, dot / norm), F.lit(0.0))


def dense_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``vectors`` (id, embedding, ...) -> the ``k`` rows nearest the query, with ``score``; ties by id. Filter ``vectors`` before, and the scan does it."""
    return vectors.withColumn("score", cosine(F.col("embedding"), query)).drop("embedding").orderBy(F.desc("score"), "id").limit(k)


def _count(text: str, part: str) -> Column:
    """How often ``part`` stands in ``text``, by what leaving it out takes off."""
    return F.expr(f"cast((char_length({text}) - char_length(replace({text}, '{part}', ''))) / {len(part)} AS int)")


def bm25_topk(passages: DataFrame, terms: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
    """``passages`` (content, ...) -> the ``k`` rows that rank highest for the terms (runs of a-z and 0-9), with ``score``.

    One scan of the passages, which leaves their counts, and no shuffle; the counts are summed to a row of statistics, then scored, k rows a task.
    """
    keep = [c for c in passages.columns if c != "content"]
    words = passages.select(*keep, F.trim(F.regexp_replace(F.lower("content"), "[^a-z0-9]+", " ")).alias("_t"))
    words = words.select(*keep, F.when(F.col("_t") == "", 0).otherwise(_count("_t", " ") + 1).alias("_n"), F.concat(F.lit(" "), F.replace("_t", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("_t"))
    # Written once: the statistics and the scores read counts, not texts.
    counted = checkpointed(words.select(*keep, "_n", *[_count("_t", f" {w} ").alias(f"_tf{i}") for i, w in enumerate(terms)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("_n").alias("mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        weight = math.log(1 + (stats.n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"_tf{i}")
        score = score + weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / (stats.mean or 1.0)))
    best = counted.withColumn("score", score).select(*keep, "score").orderBy(F.desc("score"), *keep).limit(k)
    return best.where("score > 0")  # behind the limit: pushed below the projections it would tokenise once for each term


def ranked(hits: DataFrame, key: list[str]) -> DataFrame:
    """Hits (a top-k list, so few rows) with their ``rank`` from 1."""
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), *key)))


def rrf(dense: DataFrame, sparse: DataFrame, key: list[str], keep: int = KEEP, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two top-k lists; what only one list has stays in."""
    d = ranked(dense, key).select(*key, F.col("score").alias("dense_score"), F.col("rank").alias("_d"))
    s = ranked(sparse, key).select(*key, F.col("score").alias("bm25_score"), F.col("rank").alias("_s"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = d.join(s, key, "full").withColumn("score", part("_d") + part("_s"))
    method = F.when(F.col("_d").isNull(), "bm25").when(F.col("_s").isNull(), "dense").otherwise("both")
    return both.select(*key, "score", "dense_score", "bm25_score", method.alias("retrieval_method")).orderBy(F.desc("score"), *key).limit(keep)


def parent_context(hits: DataFrame, all_chunks: DataFrame) -> DataFrame:
    """Hits (doc_id, chunk_index, ...) with the chunk's content and the ones before and after; the hits are the small side of one join."""
    near = hits.select("doc_id", "chunk_index", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_o")).withColumn("_at", F.col("chunk_index") + F.col("_o"))
    text = all_chunks.select("doc_id", F.col("chunk_index").alias("_at"), "content")
    got = near.join(text, ["doc_id", "_at"])
    of = lambda o: F.max(F.when(F.col("_o") == o, F.col("content")))
    context = got.groupBy("doc_id", "chunk_index").agg(of(-1).alias("before"), of(0).alias("content"), of(1).alias("after"))
    return hits.join(context, ["doc_id", "chunk_index"])


def provenance(fused: DataFrame, edges: DataFrame, violations: DataFrame) -> DataFrame:
    """The evidence record of each fused hit (a top-k list): where it was found, the edge of the evidence graph that leads from its document (the first by target), and the rules that the document breaks."""
    hits = fused.select(
        F.concat_ws("#", "doc_id", "chunk_index").alias("evidence_id"), F.col("doc_id").alias("document_id"), F.col("chunk_index").alias("chunk_id"), "retrieval_method", "dense_score", "bm25_score",
        F.lit(None).cast("double").alias("reranker_score"), F.concat(F.lit("DOC-"), "doc_id").alias("parent_section"),
    )
    wanted = F.broadcast(hits.select("parent_section").distinct())  # a top-k list
    paths = edges.join(wanted, edges["source_id"] == wanted["parent_section"]).groupBy("parent_section").agg(F.min("target_id").alias("_to")).select("parent_section", F.concat("parent_section", F.lit(" > "), "_to").alias("graph_path"))
    rules = violations.join(wanted, violations["record_id"] == wanted["parent_section"]).groupBy("parent_section").agg(F.sort_array(F.collect_set("rule_id")).alias("regulatory_citations"))
    return hits.join(paths, "parent_section", "left").join(rules, "parent_section", "left").withColumn("regulatory_citations", F.coalesce("regulatory_citations", F.array().cast("array<string>")))
