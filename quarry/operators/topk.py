"""The k best of many candidates for each of many queries, held by one task in bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.functions.vectors import rounded

HELD = 1 << 20  # candidates before the worse ones are dropped
NAMES = ["query_id", "chunk_id", "score"]
SCHEMA = "query_id long, chunk_id long, score double"


class Best:
    """Candidates by query: greater scores (to six digits) first, smaller ids for ties. Kept are k a query and what came since."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf)  # the k-th best so far
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates: the query's place, the id, the score."""
        keep = rounded(scores, 6) >= self.floor[at]
        self.held.append((at[keep], ids[keep], scores[keep]))
        self.size += int(keep.sum())
        if self.size > HELD:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, ids, scores = (np.concatenate(c) for c in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        shown = rounded(scores, 6)
        order = np.lexsort((ids, -shown, at))
        first = np.searchsorted(at[order], np.arange(len(self.queries)))
        rank = np.arange(len(order)) - first[at[order]]
        last = order[rank == self.k - 1]
        self.floor[at[last]] = shown[last]
        kept = order[rank < self.k]
        found = at[kept], ids[kept], scores[kept]
        self.held, self.size = [found], len(kept)
        return found

    def batch(self) -> pa.RecordBatch:
        at, ids, scores = self.prune()
        return pa.RecordBatch.from_arrays([pa.array(self.queries[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=NAMES)
