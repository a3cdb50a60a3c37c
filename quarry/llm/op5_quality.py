"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each whole text gives a row of statistics of its characters, words and lines. Standardised with the moments of all
documents, they pass through cos(Wx + b), whose scalar products approximate a Gaussian kernel. Every partition of the
labelled rows that are fitted sums its part of the normal equations (a square matrix of fixed size); the parts are
added FAN at a time, round after round, so that no task and not the driver holds more, and are solved with a ridge. Raw scores
of the other labelled rows, one in CALIBRATE by a hash of the id, which the ridge hasn't seen, are counted by thousandths and
calibrated by pooling adjacent violators, so a score is the chance of label 1.

Defined cases: a null text is empty; an empty text has all statistics zero and gets a score like any other; labels of
repeated ids are averaged and rounded; labels other than 0 and 1 and null ones aren't learned from; without a labelled
row to fit every score is 0.5; without one to calibrate a score is the raw one, kept within 0 and 1; rows of equal text have
equal scores. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, buffers, cut, held_out, id_text, pieces, rows_of, table, windows

THRESHOLD = 0.3
FEATURES = 384
WIDTH = 1.0  # kernel width as a share of the square root of the number of statistics
RIDGE = 1e-3  # a training row
SEED = 7
FAN = 16  # parts of the normal equations that one task adds
CALIBRATE = 4  # one labelled row of so many calibrates, the others are fitted
BINS = 1000
STEP = 1 << 20

UPPER, LOWER, DIGIT, SPACE, LINE, STOP, MARK, SYMBOL, BAR, HIGH, LEAD = range(11)


def _kinds() -> np.ndarray:
    out = np.full(256, SYMBOL, np.uint8)
    out[65:91], out[97:123], out[48:58] = UPPER, LOWER, DIGIT
    out[:33], out[10] = SPACE, LINE
    for chars, k in ((b".,;:'\"()-", STOP), (b"!?", MARK), (b"|<>{}[]", BAR)):
        for c in chars:
            out[c] = k
    out[0x80:0xC0], out[0xC0:] = HIGH, LEAD
    return out


KINDS = _kinds()
NAMES = (
    "log_chars", "log_words", "log_lines", "word_length", "upper", "digit", "space", "line", "stop", "mark", "symbol", "bar", "accents",
    "log_distinct", "distinct", "distinct_lines", "top_word", "repeats", "word_spread", "line_words",
)


def byte_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of each kind in each row."""
    out = np.zeros((len(at) - 1, 11), np.int64)
    for a, b in windows(len(raw), STEP):
        _, starts = pieces(at, a, b)
        kinds = KINDS[raw[a:b]]
        rows = rows_of(at, starts + a)
        ids = np.repeat(np.arange(len(starts), dtype=np.int64), np.diff(np.append(starts, b - a)))
        out_part = np.bincount(ids * 11 + kinds, minlength=len(starts) * 11).reshape(-1, 11)
        np.add.at(out, rows, out_part)
    return out


def word_statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 8
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    lines = [s for s in text.split(b"\n") if s.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return (n, float(lengths.mean()), float(lengths.std()), len(distinct), len(set(lines)) / len(lines), again / n, pairs / max(n - 1, 1), n / len(lines))


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of len(NAMES) statistics for each row of text."""
    kinds = byte_counts(raw, at).astype(np.float64)
    data, ends = raw.tobytes(), at.tolist()
    w = np.array([word_statistics(data[a:b]) for a, b in zip(ends, ends[1:])], np.float64).reshape(-1, 8)
    chars = kinds.sum(axis=1) - kinds[:, HIGH]
    part = lambda k: kinds[:, k] / np.maximum(chars, 1)
    n = np.maximum(w[:, 0], 1)
    out = [
        np.log1p(chars), np.log1p(w[:, 0]), np.log1p(kinds[:, LINE]), np.minimum(w[:, 1], 30), part(UPPER), part(DIGIT), part(SPACE), part(LINE), part(STOP), part(MARK), part(SYMBOL), part(BAR), part(LEAD),
        np.log1p(w[:, 3]), w[:, 3] / n, w[:, 4], w[:, 6], w[:, 5], np.minimum(w[:, 2], 30), np.log1p(w[:, 7]),
    ]
    return np.stack(out, axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(*buffers(batch.column(1)))
            flat = pa.array(x.reshape(-1), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), flat)], names=["doc_id", "x"])

    return arrow_batches(rows).mapInArrow(each, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray | None = None
    steps: np.ndarray | None = None  # raw scores at which the calibrated score changes
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weight, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), 0.5)
        if not len(self.steps):
            return np.clip(self.raw(x), 0.0, 1.0)
        return np.interp(self.raw(x), self.steps, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of zz' and zy over rows of x and y: a part for each partition, added FAN at a time until FAN are left, and those here."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, any_row = np.zeros((d, d + 1)), False
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for s in range(0, len(x), 4096):
                z = shared.value.features(x[s : s + 4096])
                a += z.T @ np.concatenate((z, y[s : s + 4096, None]), axis=1)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["part"])

    def added(parts: list[bytes]) -> np.ndarray:
        return sum((np.frombuffer(p).reshape(d, d + 1) for p in parts), np.zeros((d, d + 1)))

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [key[0]], "part": [added(frame["part"]).tobytes()]})

    n = rows.rdd.getNumPartitions()
    parts = rows.select("x", "y").mapInArrow(part, "part binary").select(F.spark_partition_id().alias("g"), "part")
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.withColumn("g", F.floor(F.col("g") / FAN).cast("int")).groupBy("g").applyInPandas(add, "g int, part binary")
    total = added([r["part"] for r in parts.collect()])
    return total[:, :d], total[:, d]


def isotonic(level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of levels by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(level.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            t = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / t, t, a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(found: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """found: doc_id and x of all documents; the rows to learn from are those of found that have a label."""
    k = len(NAMES)
    moments = found.select(*[f(F.col("x")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    value = np.array([m if m is not None else 0.0 for m in moments], np.float64).reshape(k, 2)
    rng = np.random.default_rng(SEED)
    model = Model(value[:, 0], np.maximum(value[:, 1], 1e-9), rng.normal(0, 1 / (WIDTH * np.sqrt(k)), (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))
    y = labels.where(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.round(F.avg(label_col)).alias("y"))
    every = cut(found.join(y, "doc_id").select("x", "y", (F.pmod(F.xxhash64(id_text()), F.lit(CALIBRATE)) == 0).alias("calibrates")))
    rows = every.where(~F.col("calibrates")).select("x", "y")
    a, b = _normal_equations(rows, model)
    n = a[-1, -1]
    if not n:
        return model
    model.weight = np.linalg.solve(a + RIDGE * n * np.eye(len(a)) * np.append(np.ones(FEATURES), 0), b)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.round(shared.value.raw(_matrix(batch.column(0))) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    bins = every.where("calibrates").select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # at most 2 * BINS + 1
    model.steps = np.array([r["bin"] / BINS for r in bins])
    model.levels = isotonic(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], np.float64))
    return model


def score(found: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of found's rows (doc_id and x)."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    kind = dict(found.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return found.select("doc_id", "x").mapInArrow(each, f"doc_id {kind}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(document_statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    scored = score(found, fit(found, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
