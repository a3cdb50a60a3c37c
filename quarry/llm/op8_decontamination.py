"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

The items form an inverted index whose weights are BM25 scores as a share of the item's score with itself; document
frequencies, the number of items and their mean length are those of all items. Every document is read as passages of two
half windows, so that any item lies within some passage; each passage is a query, and all items at or over the threshold
are retrieved, in three steps on arrays, for many passages at once: (1) of each item the heaviest terms stand before the
pivot, so many that the others weigh at most SLACK together and can't reach the threshold alone: only their postings are
walked; (2) these postings hold the greatest weight of each term in a block of items: where the sum of a passage's block
maxima, with the block's greatest slack, stays under the threshold, the whole block is skipped; (3) the items of the other
blocks are scored in full. All retrieved items are verified: the share of the question's word shingles, and of the
answer's words, that the passage holds.

Items are dealt into classes by length, each with half windows of a power of two, half as long again as its items at least, so what is found of
an item doesn't depend on the length of others. One pass over the documents takes PASS_BYTES of items' text; more items
mean more passes, and as all statistics are global, the same rows.

Words are runs without white space and punctuation, in lower case; characters of scripts that don't part words (Chinese,
Japanese, Thai and their neighbours) are words of their own.

Defined cases: items with a null or empty text match nothing; a null or empty document has no passage; a document
and item meet in one row however many passages match (the best one counts); rows that repeat an id give a row each;
items that repeat an id each count; a document without an id is judged by its text as any other. Extra columns are ignored
by contaminated() and stay as they are in without_leaks(), whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, table, unused

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of an item's score with itself
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 4  # items
SLACK = 0.2  # weight that an item's terms beyond the pivot may have together
MIN_HALF = 64  # words in half a passage
PASS_BYTES = 32 << 20  # of items' text in one pass
STEP = 1 << 20  # bytes of text worked on at once
CELLS = 1 << 22  # passages x blocks worked on at once
#: ASCII punctuation becomes space, so that words are compared without it.
FOLD = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))
MARKS = " -©«-±´¶-¸»¿ -⁯　-〄〈-〠・！-／：-＠"  # white space and punctuation
ALONE = "฀-໿က-႟ក-៿々-〇ぁ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
UNUSUAL = re.compile(f"[{MARKS}]|([{ALONE}])")
LAST_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=[^.!?。！？]*\w[^.!?。！？]*[.!?。！？]*\s*$)", re.S)


def words_of(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii() and UNUSUAL.search(text):
        text = UNUSUAL.sub(lambda m: f" {m[1]} " if m[1] else " ", text)
    return text.encode("utf-8", "replace").translate(FOLD).split()


def parted(text: str) -> tuple[str, str]:
    """A test item's question and answer: the whole and its last sentence."""
    return text, LAST_SENTENCE.split(text)[-1]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass
class Statistics:
    """Of all items that have words."""

    n: int
    mean: float
    df: dict[bytes, int]


def statistics_of(texts: list[list[bytes]]) -> Statistics:
    texts = [t for t in texts if t]
    return Statistics(len(texts), sum(map(len, texts)) / len(texts) if texts else 1.0, Counter(w for t in texts for w in set(t)))


def half_of(words: int) -> int:
    """Words in half a passage, for items of so many words: half as many again at least, so that a copy with insertions lies within one."""
    return max(MIN_HALF, 1 << (3 * words // 2 - 1).bit_length())


@dataclass
class Index:
    """Of the items of one class."""

    half: int
    ids: list
    terms: dict[bytes, int]
    starts: np.ndarray  # of each term's block postings before the pivot
    block: np.ndarray  # int32, of each posting
    most: np.ndarray  # float64, the greatest weight of the posting's term in its block
    slack: np.ndarray  # by block
    item_starts: np.ndarray  # of each item's terms
    item_terms: np.ndarray  # int64
    item_weights: np.ndarray  # float64
    questions: list[bytes]  # words, space-joined
    answers: list[bytes]

    def score(self, own: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Scores of items with a passage of the (ascending) terms."""
        out = np.empty(len(items))
        for j, i in enumerate(items.tolist()):
            a, b = self.item_starts[i], self.item_starts[i + 1]
            out[j] = self.item_weights[a:b][np.isin(self.item_terms[a:b], own, assume_unique=True)].sum()
        return out


def build(items: list[tuple], stats: Statistics | None = None, half: int | None = None) -> Index:
    """items: (id, question, answer), all of one class; the statistics are those of these items if none are given."""
    rows = [(i, words_of(q), words_of(a)) for i, q, a in items]
    rows = sorted((r for r in rows if r[1]), key=lambda r: (len(r[1]), r[1]))  # items of one length share a block
    stats = stats or statistics_of([r[1] for r in rows])
    half = half or half_of(max((len(r[1]) for r in rows), default=1))
    terms = {t: k for k, t in enumerate(sorted({w for r in rows for w in r[1]}))}
    most: dict[tuple[int, int], float] = {}
    slack = np.zeros(-(-len(rows) // BLOCK))
    starts, item_terms, item_weights = [0], [], []
    for j, (_, words, _) in enumerate(rows):
        own = {}
        for t, tf in Counter(words).items():
            df = stats.df[t]
            own[terms[t]] = float(np.log1p((stats.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / stats.mean)))
        total = sum(own.values())
        order = sorted(own, key=lambda k: (own[k], k))  # the lightest first
        rest = 0.0
        for k in order:
            w = own[k] / total
            if rest + w <= SLACK:
                rest += w
            else:
                at = (k, j // BLOCK)
                most[at] = max(most.get(at, 0.0), w)
        slack[j // BLOCK] = max(slack[j // BLOCK], rest)
        item_terms += sorted(own)
        item_weights += [own[k] / total for k in sorted(own)]
        starts.append(len(item_terms))
    keys = sorted(most)
    counts = np.bincount(np.array([k for k, _ in keys], np.int64), minlength=len(terms))
    return Index(
        half, [r[0] for r in rows], terms, np.concatenate(([0], np.cumsum(counts))), np.array([b for _, b in keys], np.int32), np.array([most[k] for k in keys], np.float64), slack,
        np.array(starts, np.int64), np.array(item_terms, np.int64), np.array(item_weights), [b" ".join(r[1]) for r in rows], [b" ".join(r[2] or r[1]) for r in rows],
    )


def retrieved(index: Index, texts: list[list[bytes]], threshold: float) -> list[tuple[int, int, int, float]]:
    """(text, half at which the passage begins, item, score) of all passages and items at or over the threshold."""
    n_blocks, size = len(index.slack), len(index.terms)
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    if not n_blocks or not counts.sum():
        return []
    halves = np.maximum(-(-counts // index.half), 1)  # of each text
    base = np.cumsum(halves) - halves
    total = int(halves.sum())
    ids = np.fromiter(map(index.terms.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    owner = np.repeat(base, counts) + (np.arange(len(ids)) - np.repeat(starts, counts)) // index.half
    hit = ids >= 0
    keys = np.unique(owner[hit] * size + ids[hit])  # each term once in a half
    half, term = keys // size, keys % size
    bounds = np.searchsorted(half, np.arange(total + 1))
    last = np.zeros(total, bool)
    last[base + halves - 1] = True
    out = []
    step = max(2, CELLS // n_blocks)
    for low in range(0, total, step):
        high = min(total, low + step)
        upto = min(total, high + 1)  # a passage reaches into the next half
        a, b = bounds[low], bounds[upto]
        n = index.starts[term[a:b] + 1] - index.starts[term[a:b]]
        row = np.repeat(half[a:b] - low, n)
        post = np.arange(int(n.sum())) + np.repeat(index.starts[term[a:b]] - (np.cumsum(n) - n), n)
        upper = np.bincount(row * n_blocks + index.block[post], weights=index.most[post], minlength=(upto - low) * n_blocks).reshape(-1, n_blocks)
        both = upper[: high - low].copy()
        follows = np.nonzero(~last[low:high])[0]
        both[follows] += upper[follows + 1]
        passage, block = np.nonzero((both > 0) & (both + index.slack + 1e-9 >= threshold))
        cuts = np.nonzero(np.diff(passage, prepend=-1))[0].tolist()
        for i, j in zip(cuts, [*cuts[1:], len(passage)]):
            p = int(passage[i]) + low
            items = (block[i:j, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            items = items[items < len(index.ids)]
            own = np.unique(term[bounds[p] : bounds[p + 1] if last[p] else bounds[p + 2]])
            s = index.score(own, items)
            t = int(np.searchsorted(base, p, "right")) - 1
            out += [(t, int(p - base[t]), int(items[k]), float(s[k])) for k in np.nonzero(s >= threshold - 1e-9)[0]]
    return out


def overlap_of(question: list[bytes], answer: list[bytes], passage: list[bytes]) -> tuple[float, float]:
    """The share of the question's shingles, and of the answer's words, that the passage holds."""
    if len(question) < SHINGLE:
        n = len(question)
        q = float(any(passage[i : i + n] == question for i in range(len(passage) - n + 1)))
    else:
        own = shingles(question)
        q = len(own & shingles(passage)) / len(own)
    wanted = set(answer)
    return q, len(wanted.intersection(passage)) / len(wanted)


def matches(index: Index, texts: list[list[bytes]], threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, share of the question, share of the answer): verified, the best passage of each."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for t, half, item, s in retrieved(index, texts, threshold):
        q, a = overlap_of(index.questions[item].split(b" "), index.answers[item].split(b" "), texts[t][half * index.half : (half + 2) * index.half])
        if q >= overlap and a >= overlap:
            best[t, item] = max(best.get((t, item), (0.0, 0.0, 0.0)), (s, q, a))
    return [(*k, *v) for k, v in best.items()]


def _passes(items: DataFrame, id_col: str) -> Iterator[list[Index]]:
    """The indexes of each pass: PASS_BYTES of items' text at most, unless one item is larger."""
    rows = items.where("question is not null").select(F.col(id_col).cast("long").alias("id"), "question", "answer")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(q.as_py()) for q in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary())), pa.array([len(w) for w in words], pa.int64())], names=["id", "question", "answer", "terms", "n"])

    rows = cut(arrow_batches(rows).mapInArrow(each, "id long, question string, answer string, terms array<binary>, n long").where("n > 0"))
    size = F.octet_length("question") + F.octet_length("answer")
    n, mean, total = rows.agg(F.count("*"), F.avg("n"), F.coalesce(F.sum(size), F.lit(0))).first()
    if not n:
        return
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    passes = -(-total // PASS_BYTES)
    df = cut(df) if passes > 1 else df
    for k in range(passes):
        part = rows.where(F.pmod(F.xxhash64("question", "answer", "id"), F.lit(passes)) == k) if passes > 1 else rows
        own = part.select(F.explode("terms").alias("term")).distinct().join(df, "term") if passes > 1 else df
        stats = Statistics(n, mean, {bytes(r[0]): r[1] for r in own.collect()})  # the terms of one pass
        classes: dict[int, list[tuple]] = {}
        for r in part.orderBy("id", "question", "answer").collect():
            classes.setdefault(half_of(r["n"]), []).append((r["id"], r["question"], r["answer"]))
        yield [build(classes[h], stats, h) for h in sorted(classes)]


def benchmark_items(items: DataFrame, text_col: str = "text") -> DataFrame:
    """items with question and answer, taken from the text as parted() does."""
    answer = F.udf(lambda t: parted(t)[1] if t is not None else None, "string")  # on the few items only
    return items.select([c for c in items.columns if c.lower() not in ("question", "answer")]).withColumn("question", F.col(text_col).cast("string")).withColumn("answer", answer(F.col(text_col).cast("string")))


def _found(indexes: list[Index], column: pa.Array, threshold: float, overlap: float) -> list[tuple]:
    """(row, item's id, score, share of the question, share of the answer) of a batch of texts."""
    out, texts, at, size, n = [], [], 0, 0, len(column)
    for i in range(n + 1):
        if texts and (size > STEP or i == n):
            for index in indexes:
                out += [(at + t, index.ids[item], *rest) for t, item, *rest in matches(index, texts, threshold, overlap)]
            texts, at, size = [], i, 0
        if i < n:
            t = column[i].as_py() or ""
            texts.append(words_of(t))
            size += len(t)
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "item_id", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item id, score, question_overlap, answer_overlap); items have question and answer."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, {id_col} long, score double, question_overlap double, answer_overlap double"
    names = ["doc_id", id_col, "score", "question_overlap", "answer_overlap"]
    out = None
    for indexes in _passes(items, id_col):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _found(shared.value, batch.column(1), threshold, overlap)
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=names)

        part = arrow_batches(rows).mapInArrow(each, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), benchmark_items(table(spark, sf_dir, "benchmark")))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "item_id", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without the rows whose text holds a test item (items as benchmark_items() takes them); no row is shuffled."""
    names, out = docs.columns, docs
    text = unused(names, "text")
    for indexes in _passes(benchmark_items(items), id_col):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _found(shared.value, batch.column(len(names)), threshold, overlap)]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep))

        out = arrow_batches(out.withColumn(text, F.col("text").cast("string"))).mapInArrow(clean, docs.schema)
    return out
