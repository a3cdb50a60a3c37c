"""Language ID by prediction by partial matching (PPM) over bytes.

Each language has a context tree of variable order up to ORDER over the bytes of UTF-8, with a mark for the start of a
text. Its nodes are all byte strings of up to ORDER + 1 bytes that hold at least one LEAVES-th of the language's
bytes, so a tree has at most LEAVES nodes of each length, whatever the input, and frequent contexts are longer than
rare ones. A byte that a context has seen n of t times, with d different bytes seen, costs -log2(n / (t + d))
bits; an unseen one costs the escape -log2(d / (t + d)) and is coded by the next shorter context that the tree has, down to
a uniform order -1 (escape method C). Statistics are counted once over all training rows and frozen; the code length of a
whole text is then exact, and the language with the shortest one is predicted.

Counts are combined by language and string before the shuffle and cut to the trees' nodes in Spark; the driver fetches
at most (ORDER + 1) * NODES of them, as languages share NODES leaves once they are many.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned;
ties go to the language first in order; rows with null lang aren't learned from; a language whose training rows hold no byte
isn't learned. Extra columns stay as they are in known_language() and in the kept columns of predict(), but for those named like one
of its results, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, buffers, cut, held_out, pieces, rows_of, table, windows

ORDER = 3
PAD = 256  # before a text's first byte
BASE = 257
LEAVES = 1 << 16  # nodes of each length in a language's tree
NODES = 1 << 20  # and in those of all languages
FEW_LANGS = 10_000  # whose totals are broadcast
STEP = 1 << 20  # bytes worked on at once
MERGE = 1 << 21  # counts that a task holds before they are combined, and twice as many before they are given
SLOTS = 1 << 20  # of the hash that finds most strings at once
LETTER = r"\p{L}"
#: A text is in no learned language if its code is longer than so many bits a byte, and so many for the text: hashes and
#: numbers in a short text cost as much as a foreign script.
MAX_BITS, ALLOWANCE = 12.0, 512.0


def strings_of(symbols: np.ndarray, at: np.ndarray, a: int, b: int, base: int, pad: int) -> np.ndarray:
    """For symbols a..b of the rows at the offsets: the ORDER symbols before and the symbol, as one number."""
    low = max(0, a - ORDER)
    s = symbols[low:b].astype(np.int64)
    starts = np.unique(at[(at >= low) & (at < b)]) - low
    out = s.copy()
    power = 1
    for k in range(1, ORDER + 1):
        power *= base
        before = np.full(len(s), pad, np.int64)
        before[k:] = s[:-k]
        for j in range(k):  # the first k symbols of a row have none there
            own = starts[starts + j < len(s)] + j
            before[own] = pad
        out += before * power
    return out[a - low :]


def _combined(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)


def count_strings(rows: DataFrame) -> DataFrame:
    """(lang, code, n): the strings of ORDER + 1 symbols over all rows of columns lang and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            while held:
                lang, (codes, counts) = held.popitem()
                code, n = _combined(codes, counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(code), np.int64))), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                raw, at = buffers(batch.column(1).filter(pa.array(langs == lang)))
                for a, b in windows(len(raw), STEP):
                    code, n = np.unique(strings_of(raw, at, a, b, BASE, PAD), return_counts=True)
                    codes, counts = held.setdefault(lang, ([], []))
                    codes.append(code)
                    counts.append(n)
                    size += len(code)
                    if size > MERGE:
                        for k, (codes, counts) in held.items():
                            code, n = _combined(codes, counts)
                            held[k] = ([code], [n])
                        size = sum(len(c[0][0]) for c in held.values())
                        if size > MERGE // 2:
                            yield from told()
                            size = 0
        yield from told()

    return arrow_batches(rows.select("lang", "text")).mapInArrow(each, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def tree_nodes(rows: DataFrame, leaves: int = LEAVES, nodes: int = NODES) -> DataFrame:
    """(lang, order, code, n): the nodes of the trees; code is the string, its last symbol the lowest digit of base BASE."""
    every = cut(count_strings(rows))
    total = every.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = total.count()
    least = total.select("lang", (F.col("total") / min(leaves, max(1, nodes // max(1, langs)))).alias("least"))
    least = F.broadcast(least) if langs <= FEW_LANGS else least  # a row a language
    digits = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), (F.col("code") % BASE ** (k + 1)).alias("code")) for k in range(ORDER)]))
    deepest = every.select("lang", F.lit(ORDER).alias("order"), "code", "n")
    shorter = every.select("lang", digits.alias("w"), "n").groupBy("lang", "w.order", "w.code").agg(F.sum("n").alias("n"))
    return deepest.unionByName(shorter).join(least, "lang").where(F.col("n") >= F.col("least")).drop("least")


class Table:
    """Rows of numbers by string: a hash finds most strings at once, a search the others."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.codes, self.rows = codes, rows
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[self._hash(codes)] = np.arange(len(codes), dtype=np.int32)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether the string is here)."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = self.slots[self._hash(codes)].astype(np.int64)
        found = self.codes[at] == codes
        lost = np.nonzero(~found)[0]
        if len(lost):
            again = np.minimum(np.searchsorted(self.codes, codes[lost]), len(self.codes) - 1)
            at[lost], found[lost] = again, self.codes[again] == codes[lost]
        return at, found


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # by byte: its number in the tables; 0 is the pad, 1 a byte that no tree has
    base: int
    costs: list[Table]  # by order: bits of the last symbol of a string after the others, by language
    escapes: list[Table]  # by order: bits of the escape from a context, by language; 0 where the tree doesn't have it


def compiled(langs: list[str], lang: np.ndarray, order: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """The model of the trees whose nodes are given; lang is the place in langs."""
    seen = np.unique(code[(order == 0)])
    symbol = np.ones(BASE, np.int64)
    symbol[PAD] = 0
    symbol[seen[seen != PAD]] = np.arange(2, 2 + np.count_nonzero(seen != PAD))
    base = int(symbol.max()) + 1
    costs, escapes = [], []
    for k in range(ORDER + 1):
        here = order == k
        own, rest = np.zeros(here.sum(), np.int64), code[here]
        for j in range(k + 1):
            own += symbol[rest % BASE] * base**j
            rest = rest // BASE
        of, count = lang[here], n[here]
        every = np.unique(own)
        lower = np.full((len(every), len(langs)), 8.0) if not k else costs[-1].rows[costs[-1].find(every % base**k)[0]].astype(np.float64)
        contexts = np.unique(every // base)
        cost, escape = lower.copy(), np.zeros((len(contexts), len(langs)))
        for i in range(len(langs)):
            mine, times = own[of == i], count[of == i].astype(np.float64)
            ctx = np.searchsorted(contexts, mine // base)
            t, d = np.bincount(ctx, times, len(contexts)), np.bincount(ctx, minlength=len(contexts))
            there = d > 0
            escape[there, i] = -np.log2(d[there] / (t + d)[there])
            cost[:, i] += escape[np.searchsorted(contexts, every // base), i]
            cost[np.searchsorted(every, mine), i] = -np.log2(times / (t + d)[ctx])
        costs.append(Table(every, cost.astype(np.float32)))
        escapes.append(Table(contexts, escape.astype(np.float32)))
    return Model(langs, symbol[:256], base, costs, escapes)


def learn(rows: DataFrame) -> Model:
    """rows: lang (not null) and text. Only the trees' nodes, a bounded number, are fetched."""
    got = tree_nodes(rows).toArrow()
    names, lang = np.unique(got["lang"].to_numpy().astype(str), return_inverse=True)
    return compiled(names.tolist(), lang, *(got[c].to_numpy().astype(np.int64) for c in ("order", "code", "n")))


def symbol_bits(model: Model, codes: np.ndarray) -> np.ndarray:
    """Bits of the last symbol of each string of ORDER + 1, by language."""
    at, found = model.costs[ORDER].find(codes)
    out = model.costs[ORDER].rows[at] if len(model.costs[ORDER].codes) else np.zeros((len(codes), len(model.langs)), np.float32)
    todo = np.nonzero(~found)[0]
    out[todo] = 0
    for k in range(ORDER, -1, -1):
        if not len(todo):
            break
        own = codes[todo] % model.base ** (k + 1)
        if k < ORDER:
            at, found = model.costs[k].find(own)
            hit = todo[found]
            out[hit] += model.costs[k].rows[at[found]]
            todo, own = todo[~found], own[~found]
        at, found = model.escapes[k].find(own // model.base)
        out[todo[found]] += model.escapes[k].rows[at[found]]
    out[todo] += 8.0
    return out


def text_bits(model: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code length of each row in each language."""
    out = np.zeros((len(at) - 1, len(model.langs)))
    symbols = model.symbol[raw]
    for a, b in windows(len(raw), STEP):
        _, starts = pieces(at, a, b)
        bits = symbol_bits(model, strings_of(symbols, at, a, b, model.base, 0))
        np.add.at(out, rows_of(at, starts + a), np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
    return out


RESULTS = ("lang_pred", "score", "bits")


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, most_bits: float | None = None) -> DataFrame:
    """The columns to keep (all if None) and lang_pred, score (the posterior of the prediction under equal priors) and bits (a byte).

    With most_bits, only the kept columns of the rows in a learned language: in at most so many bits a byte and ALLOWANCE.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if most_bits is not None or c.lower() not in RESULTS]
    width = len(keep)
    inner = [f"_{i}" for i in range(width)]  # so that no name of theirs clashes with one made here
    text = F.col("text").cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)], F.coalesce(text, F.lit("")).alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("letters"))
    made = rows.select(*inner)
    schema = (made if most_bits is not None else made.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits": F.lit(0.0)})).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, at = buffers(batch.column(width))
            known = batch.column(width + 1).to_numpy(zero_copy_only=False).astype(bool)
            n = len(known)
            best, score, bits, least = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n)
            if m.langs:
                total = text_bits(m, raw, at)
                best = total.argmin(axis=1)
                least = total[np.arange(n), best]
                score = 1.0 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(axis=1)
                bits = least / np.maximum(np.diff(at), 1)
            else:
                known[:] = False
            if most_bits is not None:
                yield pa.RecordBatch.from_arrays(batch.columns[:width], names=inner).filter(pa.array(known & (least <= most_bits * np.diff(at) + ALLOWANCE)))
                continue
            names = [m.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            columns = [*batch.columns[:width], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = arrow_batches(rows).mapInArrow(each, schema)
    return found.select(*[F.col(i).alias(c) for c, i in zip(keep, inner)], *schema.names[width:])


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(training_rows(docs)), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")


def known_language(docs: DataFrame, max_bits: float = MAX_BITS) -> DataFrame:
    """docs without those in no learned language: no letter in them, or over max_bits bits a byte and ALLOWANCE in every language.

    The columns stay as they are. Without any labelled row nothing is rejected but what has no letter.
    """
    model = learn(training_rows(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike(LETTER))
    return predict(docs, model, most_bits=max_bits)
