"""Okapi BM25 by document: statistics of the whole corpus, scores inside each document's row, the k best of each task.

No posting is shuffled. Statistics are counts of terms, combined in each task; a search sends the asked terms, a bounded
number a round, to the documents, and each task gives back k hits a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions.text import tokens
from quarry.functions.vectors import rounded_column
from quarry.operators.topk import SCHEMA, Best

ROUND = 1 << 20  # asked terms (by query) that are sent to the documents at once; more are asked in rounds
CELLS = 1 << 22  # documents x queries scored at once


@dataclass
class Index:
    listed: DataFrame  # chunk_id, t (its tokens): documents that have some
    terms: DataFrame  # term, df, idf
    totals: DataFrame  # one row: n, avgdl


def postings(docs: DataFrame, chunk_id: str, text) -> DataFrame:
    """(term, chunk_id, tf)."""
    return docs.select(F.col(chunk_id).alias("chunk_id"), F.explode(tokens(text)).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def build(docs: DataFrame, chunk_id: str, text) -> Index:
    """Documents without a token aren't in the index. Negative idf becomes epsilon times the mean idf of all terms."""
    listed = docs.select(F.col(chunk_id).alias("chunk_id"), tokens(text).alias("t")).where(F.size("t") > 0)
    totals = listed.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    counted = listed.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = counted.crossJoin(F.broadcast(totals)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # totals: one row
    mean = raw.agg((SETTINGS.bm25_epsilon * F.avg("raw")).alias("floor"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return Index(listed, terms, totals)


def query_terms(queries: DataFrame, query_id: str, text) -> DataFrame:
    """(query_id, term, qtf): a repeated term counts as often."""
    return queries.select(F.col(query_id).cast("long").alias("query_id"), F.explode(tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Asked:
    """The queries of a round: for each term the queries that ask it and their weights, as runs of two arrays."""

    queries: np.ndarray
    place: dict[str, int]
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    mean: float


def _rounds(weighted: DataFrame, mean: float) -> Iterator[Asked]:
    size = weighted.count()
    rounds = max(1, -(-size // ROUND))
    for k in range(rounds):
        part = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == k) if rounds > 1 else weighted
        rows = part.select("term", "query_id", (F.col("qtf") * F.col("idf")).alias("w")).orderBy("term", "query_id").collect()
        if rows:
            queries, query = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)
            place: dict[str, int] = {}
            of = np.array([place.setdefault(r[0], len(place)) for r in rows])
            yield Asked(queries, place, np.searchsorted(of, np.arange(len(place) + 1)), query, np.array([r[2] for r in rows], np.float64), mean)


def _scored(asked: Asked, lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, scores by document and query) of documents' tokens."""
    k1, b = SETTINGS.bm25_k1, SETTINGS.bm25_b
    at = lists.offsets.to_numpy()
    flat = lists.values.dictionary_encode() if len(lists.values) else pa.array([], pa.string()).dictionary_encode()
    known = np.array([asked.place.get(t, -1) for t in flat.dictionary.to_pylist()] or [-1], np.int64)
    term = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    length = np.diff(at).astype(np.float64)
    step, terms = max(1, CELLS // len(asked.queries)), len(asked.place)
    for low in range(0, len(length), step):
        high = min(len(length), low + step)
        own = term[at[low] : at[high]]
        doc = np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
        pairs, tf = np.unique((doc * terms + own)[own >= 0], return_counts=True)
        doc, own = pairs // terms, pairs % terms
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[low:high][doc] / asked.mean))
        n = asked.starts[own + 1] - asked.starts[own]
        post = np.arange(int(n.sum())) + np.repeat(asked.starts[own] - (np.cumsum(n) - n), n)
        cell = np.repeat(doc, n) * len(asked.queries) + asked.query[post]
        yield low, np.bincount(cell, np.repeat(part, n) * asked.weight[post], (high - low) * len(asked.queries)).reshape(high - low, -1)


def search(index: Index, asked: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, score): the k best with a positive score, as a share of the best.

    asked is that of query_terms(). Statistics are those of the whole index; allowed (chunk_id) restricts what is ranked.
    """
    spark = index.listed.sparkSession
    mean = index.totals.first()["avgdl"] or 1.0
    listed = index.listed if allowed is None else index.listed.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = listed.select(F.col("chunk_id").cast("long").alias("chunk_id"), "t")
    found = spark.createDataFrame([], SCHEMA)
    weighted = asked.join(index.terms, "term").persist()
    for one in _rounds(weighted, mean):
        shared = spark.sparkContext.broadcast(one)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best = Best(own.queries, k)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for low, s in _scored(own, batch.column(1)):
                    doc, query = np.nonzero(s > 0)
                    best.add(query, ids[low + doc], s[doc, query])
            yield best.batch()

        found = found.unionByName(rows.mapInArrow(each, SCHEMA))
    weighted.unpersist()
    order = Window.partitionBy("query_id").orderBy(rounded_column(F.col("score"), 6).desc(), "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    peak = F.max("score").over(Window.partitionBy("query_id"))
    return best.select("query_id", "chunk_id", "rank", rounded_column(F.col("score") / peak, 4).alias("score"))
