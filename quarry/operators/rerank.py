"""Second-stage ordering of a question's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions.text import tokens


def heuristic(candidates: DataFrame) -> DataFrame:
    """Adds rerank_score: coverage of the question's terms, their rarity in the pool, their density.

    candidates: query_id, question, chunk_id, text, score.
    """
    q = Window.partitionBy("query_id")
    c = candidates.withColumn("_q", F.array_distinct(tokens(F.col("question")))).withColumn("_t", tokens(F.col("text")))
    c = c.withColumn("_m", F.array_intersect("_q", F.array_distinct("_t"))).withColumn("_n", F.count("*").over(q))
    terms = c.select("query_id", "chunk_id", "_n", F.explode("_m").alias("term"))
    rarity = terms.withColumn("df", F.count("*").over(Window.partitionBy("query_id", "term"))).groupBy("query_id", "chunk_id").agg(F.sum(F.log(1 + F.col("_n") / (1 + F.col("df")))).alias("_idf"))
    c = c.join(rarity, ["query_id", "chunk_id"], "left")
    hits = F.size(F.filter("_t", lambda t: F.array_contains("_m", t)))
    full = F.size("_q") * F.log(1 + F.col("_n") / F.lit(1.0))
    made = 0.5 * F.size("_m") / F.size("_q") + 0.3 * F.col("_idf") / full + 0.2 * F.least(F.lit(1.0), hits / F.greatest(F.size("_t"), F.lit(1)) * 12)
    score = F.when(F.size("_q") == 0, F.col("score")).when(F.size("_m") == 0, 0.05 * F.col("score")).otherwise(F.round(made, 4))
    return c.withColumn("rerank_score", score).drop("_q", "_t", "_m", "_n", "_idf")


def cross_encoded(candidates: DataFrame, logit: str = "logit") -> DataFrame:
    """Adds rerank_score from a model's logits."""
    return candidates.withColumn("rerank_score", 1 / (1 + F.exp(-F.col(logit))))


def rerank(candidates: DataFrame, k: int = SETTINGS.top_k, mode: str = "heuristic") -> DataFrame:
    """The k best of each question's first candidates, with final_rank: rerank and first-stage score blended.

    candidates: query_id, question, chunk_id, text, score, rank. Mode off, and questions with one candidate, keep the order.
    """
    q = Window.partitionBy("query_id")
    pool = candidates.where(F.col("rank") <= SETTINGS.rerank_input)
    if mode == "off":
        return pool.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.row_number().over(q.orderBy("rank"))).where(F.col("final_rank") <= k)
    scored = heuristic(pool) if mode == "heuristic" else pool
    blend = F.round(SETTINGS.rerank_weight * F.col("rerank_score") + (1 - SETTINGS.rerank_weight) * F.col("score"), 6)
    scored = scored.withColumn("blend", blend)
    return scored.withColumn("final_rank", F.row_number().over(q.orderBy(F.col("blend").desc(), "rank"))).where(F.col("final_rank") <= k)
