"""Retrieval as one operator: all planned queries through both arms, fusion, relevance floor, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions.text import strip
from quarry.operators import bm25, calls, dense, fusion

FAN_BITS = 6  # of a fan-out id: the place of a query among a question's queries


def fan_out(questions: DataFrame, extras: str | None = "extras") -> DataFrame:
    """(fan_id, query_id, i, text): the question (i = 0) and its further queries that aren't null, empty or the question again.

    questions: query_id (below 2^57), question and, if named, an array of further queries, 2^6 - 1 at most.
    """
    more = F.coalesce(F.col(extras), F.array().cast("array<string>")) if extras else F.array().cast("array<string>")
    kept = F.filter(more, lambda s: (F.coalesce(s, F.lit("")) != "") & (strip(s) != strip(F.col("question"))))
    every = questions.select("query_id", F.posexplode(F.concat(F.array("question"), F.slice(kept, 1, 2**FAN_BITS - 1))).alias("i", "text"))
    return every.select((F.shiftleft(F.col("query_id").cast("long"), FAN_BITS) + F.col("i")).alias("fan_id"), "query_id", "i", "text")


def hits(fan: DataFrame, index: bm25.Index, vectors: DataFrame, pool: int = SETTINGS.pool, mode: str = "hybrid", allowed: DataFrame | None = None, encode: calls.Encode | None = None, blank: float = 0.0) -> DataFrame:
    """(query_id, arm, rank, chunk_id, score) of every query in every arm that the mode names; each query's list is a list of its own.

    blank is the cosine where a vector has no length: 0, or NaN, which ranks first.
    """
    own = {}
    if mode in ("hybrid", "dense"):
        near = vectors if allowed is None else vectors.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
        asked = calls.embed(fan, "text", "query", encode).select(F.col("fan_id").alias("query_id"), "embedding")
        own["dense"] = dense.search(asked, near, pool, blank=blank)
    if mode in ("hybrid", "sparse"):
        own["sparse"] = bm25.search(index, bm25.query_terms(fan, "fan_id", F.col("text")), pool, allowed)
    if not own:
        return fan.select("query_id", F.lit("none").alias("arm"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    return fusion.lists(own).withColumn("query_id", F.shiftright("query_id", FAN_BITS))


def retrieve(questions: DataFrame, index: bm25.Index, vectors: DataFrame, top_k: int = SETTINGS.top_k, mode: str = SETTINGS.retrieval_mode, extras: str | None = "extras", allowed: DataFrame | None = None, diverse: bool = True, encode: calls.Encode | None = None, blank: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, rank, score, dense_score, sparse_score, sources): up to max(top_k, 20) candidates a question.

    questions: query_id, question and further queries; vectors: chunk_id and embedding of what the index holds. The mode is hybrid,
    dense or sparse; another one finds nothing. More than top_k hits are diversified where the mode has query vectors. blank is that of hits().
    """
    mode = mode.lower()
    depth = max(top_k, SETTINGS.rerank_input)
    fan = fan_out(questions, extras)
    fused = fusion.fuse(hits(fan, index, vectors, max(SETTINGS.pool, 4 * top_k), mode, allowed, encode, blank), top_k=top_k)
    kept = ["query_id", "chunk_id", "score", "dense_score", "sparse_score", "sources"]
    if not diverse or mode not in ("hybrid", "dense"):
        return fused.where(F.col("rank") <= depth).select(*kept[:2], "rank", *kept[2:])
    shortlist = fused.withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("rank") <= max(2 * depth, 4 * top_k))
    few = shortlist.where(F.col("_n") <= top_k).select("query_id", "chunk_id", "rank")
    primary = calls.embed(fan.where("i = 0"), "text", "query", encode).select("query_id", F.col("embedding").alias("query_embedding"))
    # the shortlist is at most max(2 * depth, 4 * top_k) rows a question
    many = vectors.select("chunk_id", "embedding").join(shortlist.where(F.col("_n") > top_k).select("query_id", "chunk_id", "rank"), "chunk_id", "right")
    picked = fusion.mmr(many.join(primary, "query_id"), depth, blank=blank).withColumnRenamed("pick", "rank")
    return fused.select(*kept).join(few.unionByName(picked), ["query_id", "chunk_id"]).select(*kept[:2], "rank", *kept[2:])
