"""Fusion of ranked lists: reciprocal ranks, merged arms, relevance floor, maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions.vectors import cosines, measured, rounded


def lists(arms: dict[str, DataFrame]) -> DataFrame:
    """One long table (query_id, arm, rank, chunk_id, score) of the arms' hits."""
    out = None
    for arm, hits in arms.items():
        part = hits.select("query_id", F.lit(arm).alias("arm"), "rank", "chunk_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(hits: DataFrame, k: int = SETTINGS.rrf_k) -> DataFrame:
    """(query_id, chunk_id, rrf, dense_score, sparse_score, sources): each hit's sum of 1 / (k + rank)."""
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("score")))
    return hits.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"), of("dense").alias("dense_score"), of("sparse").alias("sparse_score"), F.array_sort(F.collect_set("arm")).alias("sources")
    )


def fuse(hits: DataFrame, k: int = SETTINGS.rrf_k, floor: float = SETTINGS.relevance_floor, top_k: int = SETTINGS.top_k) -> DataFrame:
    """rrf() with rank and score, the share of the query's best; hits under the floor go unless all would."""
    q = Window.partitionBy("query_id")
    fused = rrf(hits, k).withColumn("score", F.round(F.col("rrf") / F.max("rrf").over(q), 4))
    fused = fused.withColumn("rank", F.row_number().over(q.orderBy(F.col("rrf").desc(), "chunk_id")))
    some = F.max(F.col("score") >= floor).over(q)
    return fused.withColumn("_some", some).where(F.when(F.col("_some"), F.col("score") >= floor).otherwise(F.col("rank") <= top_k)).drop("_some")


def mmr(shortlist: DataFrame, k: int, weight: float = SETTINGS.mmr_lambda, blank: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, pick) from shortlist (query_id, chunk_id, rank, query_embedding, embedding).

    Picks what is near the query and unlike the picks before it; candidates without a vector follow in rank order.
    A query's shortlist is bounded by the retriever's depth, so it is one group. blank is the cosine where a vector has no length;
    a value that is NaN for it goes before all numbers.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable")
        have = frame[frame["embedding"].notna()]
        rest = frame[frame["embedding"].isna()]["chunk_id"].tolist()
        picked: list[int] = []
        if len(have):
            v = measured(have["embedding"].tolist())
            near = cosines(v, measured([have["query_embedding"].iloc[0]]), blank)[:, 0]
            alike = cosines(v, v, blank)
            left, worst = list(range(len(near))), np.zeros(len(near))
            while left and len(picked) < k:
                i = left.pop(int(np.argmax(rounded(weight * near[left] - (1 - weight) * worst[left], 9))))
                worst = np.maximum(worst, alike[i]) if picked else alike[i]
                picked.append(i)
        ids = [have["chunk_id"].iloc[i] for i in picked] + rest
        ids = ids[:k]
        return pd.DataFrame({"query_id": [frame["query_id"].iloc[0]] * len(ids), "chunk_id": ids, "pick": range(1, len(ids) + 1)})

    return shortlist.groupBy("query_id").applyInPandas(choose, "query_id long, chunk_id long, pick int")


def hybrid(arms: dict[str, DataFrame], top_k: int = SETTINGS.top_k, mode: str = "hybrid") -> DataFrame:
    """Fused hits of the arms that the mode names: hybrid (all), dense or sparse; an unknown mode has none."""
    kept = {a: h for a, h in arms.items() if mode in ("hybrid", a)}
    if not kept:
        some = next(iter(arms.values()))
        kept = {"none": some.where(F.lit(False))}
    return fuse(lists(kept)).where(F.col("rank") <= top_k)
