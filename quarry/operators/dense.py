"""Exact nearest vectors by cosine: each task keeps its k best for each query, then the few of all tasks meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import cosines, measured, rounded_column
from quarry.operators.topk import SCHEMA, Best

ROUND_BYTES = 64 << 20  # of query vectors that are sent to the vectors at once; more are asked in rounds
CELLS = 1 << 22  # vectors x queries compared at once


def _rounds(asked: DataFrame, size: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    rounds = max(1, -(-asked.count() * size * 8 // ROUND_BYTES))
    for k in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == k) if rounds > 1 else asked
        rows = part.orderBy("query_id").collect()
        if rows:
            yield np.array([r[0] for r in rows], np.int64), measured(np.array([r[1] for r in rows], np.float64))


def search(queries: DataFrame, vectors: DataFrame, k: int, round_to: int = 4, blank: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, rank, score) from queries (query_id, embedding) and vectors (chunk_id, embedding).

    Filter vectors before the call: what is left out doesn't take a rank. Vectors of a length other than that of the
    query with the smallest id, and null ones, are left out. blank is the cosine where a vector has no length: 0, or NaN, which
    ranks before all numbers.
    """
    spark = queries.sparkSession
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).persist()
    first = asked.orderBy("query_id").first()
    found = spark.createDataFrame([], SCHEMA)
    if first is not None:
        size = len(first[1])
        near = vectors.where(F.size("embedding") == size).select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
        held = np.inf if np.isnan(blank) else blank
        for one in _rounds(asked.where(F.size("embedding") == size), size):
            shared = spark.sparkContext.broadcast(one)

            def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, asked_ = shared.value
                best, step = Best(ids, k), max(1, CELLS // len(ids))
                for batch in batches:
                    own = batch.column(0).to_numpy(zero_copy_only=False)
                    m, squares = measured(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                    for low in range(0, len(own), step):
                        s = np.maximum(cosines((m[low : low + step], squares[low : low + step]), asked_, held), 0.0)
                        doc, query = np.nonzero(s >= best.floor - 1e-6)  # add() rounds what is left
                        best.add(query, own[low + doc], s[doc, query])
                yield best.batch()

            found = found.unionByName(near.mapInArrow(each, SCHEMA))
    asked.unpersist()
    order = Window.partitionBy("query_id").orderBy(rounded_column(F.col("score"), 6).desc(), "chunk_id")
    score = F.when(F.col("score") == float("inf"), float("nan")).otherwise(rounded_column(F.col("score"), round_to))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", score.alias("score"))
