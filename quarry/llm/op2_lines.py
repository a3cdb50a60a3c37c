"""Line dedup by pairwise alignment.

Lines of at least min_words words are hashed (runs of ASCII white space as one space; the j-th occurrence of a line in its document
is a line of its own, so every hash is unique in its document, as patience diff wants). Documents overlap if they share a
rare line, one that at most RARE documents hold: a document is paired with each earlier holder of each of its rare lines.
A line that more documents hold pairs each of them with its first holder only, so a line of very many documents costs each
of them one pair, never all pairs. Each pair is aligned by patience diff: the longest run of common lines that
are in order in both. Aligned blocks of at least min_block_words words are deleted from the later document, with the
shorter lines between them where these are equal too. The first holder keeps its lines.

What common lines may still share with a later holder, and short lines, are found by runs: from each
non-empty line the shortest run of two lines or more with min_block_words words, forward and backward. A run goes if an
earlier document holds it; any shared block of two lines and as many words is the union of such runs. A line's second
and later occurrences in a document are runs of their own, so they go if an earlier document has the line once; so does
a document of fewer words than a block, if an earlier one has the same lines and no others. So an exact copy of any
earlier document becomes empty.

Only hashes and positions meet in the alignment; texts are read once more to be rewritten.

Defined cases: earlier means a smaller id, for equal ids a smaller hash of the text; null ids come last; rows equal in
id and text are one document and are treated alike; a null text stays null; an empty text stays empty; a text whose
lines are all copies becomes empty. Extra columns stay as they are; one named removed_lines gives way to the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, given_back, place, plain, table
from .words import Sequence, mixed, slices, words_of

MIN_WORDS = 8
MIN_BLOCK_WORDS = 8
RARE = 8  # documents that hold a rare line at most
LAST = 2**63 - 1


def split_lines(text: str, min_words: int) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines, and (position, words) of those that are long enough."""
    lines = text.split("\n")
    return lines, [(i, n) for i, n in enumerate(len(s.encode().split()) for s in lines) if n >= min_words]


def _ranks(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """The place of each row among those with equal keys, from 0; rows with equal keys stand together."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def line_rows(raw: np.ndarray, at: np.ndarray, min_words: int, min_block_words: int, later_holders: bool) -> dict[str, np.ndarray]:
    """Of texts at the offsets, by text (at): the long lines, and the runs, whose last line is to and whose first is k (to is -1 for lines).

    A line has its number k among the text's long lines, its hash h, those of the shorter lines before and after it (gb, ga)
    and its words w. Lines of runs are numbered among all lines of the text; empty lines don't count in a run. Runs of long lines
    alone and repeated lines are given for later_holders only; a repeated line has the hash of its first occurrence.
    """
    n = len(at) - 1
    words, text, _, starts = words_of(raw, at, lower=False)
    newlines = np.concatenate(([0], np.cumsum(raw == 10)))
    count = newlines[at[1:]] - newlines[at[:-1]] + 1  # of lines
    first = np.concatenate(([0], np.cumsum(count)))  # line of each text, among all
    line = first[text] + newlines[starts] - newlines[at[text]]
    size = np.bincount(line, minlength=first[-1])  # words of each line
    begin = np.cumsum(size) - size
    h = Sequence(words).of(begin, begin + size, 1)
    of = np.repeat(np.arange(n), count)  # text of each line
    every = Sequence(h)
    once = Sequence(h).of(np.arange(len(h)), np.arange(len(h)) + 1, 2)  # the hash of a line's first occurrence

    long = np.nonzero(size >= min_words)[0]
    order = np.lexsort((long, h[long], of[long]))
    again = np.empty(len(long), np.int64)
    again[order] = _ranks([of[long][order], h[long][order]])
    number = _ranks([of[long]]) if len(long) else long
    last = np.ones(len(long), bool)
    last[:-1] = of[long][1:] != of[long][:-1]
    before = np.where(number > 0, np.roll(long, 1) + 1, first[of[long]])
    after = np.where(last, first[of[long] + 1], np.roll(long, -1))
    out = {
        "at": of[long], "k": number, "h": np.where(again > 0, mixed(once[long] + again.astype(np.uint64)), once[long]), "gb": every.of(before, long) + (number == 0).astype(np.uint64),
        "ga": every.of(long + 1, after) + last.astype(np.uint64), "w": size[long], "to": np.full(len(long), -1),
    }

    bare = np.nonzero(size)[0]
    upto = np.concatenate(([0], np.cumsum(size[bare])))
    low, high = np.searchsorted(of[bare], np.arange(n)), np.searchsorted(of[bare], np.arange(n), "right")
    small = upto[high] - upto[low] < min_block_words  # texts that are one run as a whole
    each = np.arange(len(bare))
    to = np.maximum(each + 2, np.searchsorted(upto, upto[:-1] + min_block_words))
    start = np.minimum(each - 1, np.searchsorted(upto, upto[1:] - min_block_words, "right") - 1)
    fits, reaches = to <= high[of[bare]], start >= low[of[bare]]
    spans = np.unique(np.concatenate((each[fits] * (len(bare) + 1) + to[fits], start[reaches] * (len(bare) + 1) + each[reaches] + 1)))
    a, b = spans // (len(bare) + 1), spans % (len(bare) + 1)
    keep = ~small[of[bare[a]]] if len(a) else np.zeros(0, bool)
    if not later_holders and len(a):
        short = np.concatenate(([0], np.cumsum(size[bare] < min_block_words)))
        keep &= short[b] > short[a]
    a, b = a[keep], b[keep]
    whole = np.nonzero(small & (high > low))[0]
    a, b, tag = np.concatenate((a, low[whole])), np.concatenate((b, high[whole])), np.repeat([3, 4], [len(a), len(whole)])
    runs = Sequence(h[bare]).of(a, b) ^ mixed(tag.astype(np.uint64))
    own = [bare[a], runs, bare[b - 1] if len(b) else b]
    if later_holders:
        wide = np.nonzero(size >= min_block_words)[0]
        order = np.lexsort((wide, h[wide], of[wide]))
        repeated = wide[order][_ranks([of[wide][order], h[wide][order]]) > 0] if len(wide) else wide
        own = [np.concatenate(x) for x in zip(own, [repeated, once[repeated], repeated])]
    lines, hashes, ends = own
    none = np.zeros(len(lines), np.int64)
    more = {"at": of[lines], "k": lines - first[of[lines]], "h": hashes, "gb": none.astype(np.uint64), "ga": none.astype(np.uint64), "w": none, "to": ends - first[of[lines]]}
    return {k: np.concatenate((out[k], more[k])) for k in out}


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.withColumn("doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))).withColumn("th", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def lines_of(docs: DataFrame, min_words: int, min_block_words: int, later_holders: bool) -> DataFrame:
    """The long lines, and the runs: these have their last line in the column to and their first in k; to is null for lines."""
    rows = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc", "th", "text").where("text is not null")
    kinds = {"k": pa.int32(), "h": pa.int64(), "gb": pa.int64(), "ga": pa.int64(), "w": pa.int32(), "to": pa.int32()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, raw, at in slices(batch.column(2)):
                found = line_rows(raw, at, min_words, min_block_words, later_holders)
                place = pa.array(found["at"] + a)
                columns = [pa.array(found[n].view(np.int64), pa.int64()).cast(t) for n, t in kinds.items()]
                columns[-1] = pa.array(found["to"], pa.int32(), mask=found["to"] < 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *columns], names=["doc", "th", *kinds])

    return arrow_batches(rows).mapInArrow(each, "doc long, th long, k int, h long, gb long, ga long, w int, to int")


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of (place in one, place in the other) that rises in both; places are unique in each."""
    tails, ends, back = [], [], {}
    for p in sorted(pairs):
        i = bisect_left(tails, p[1])
        back[p] = ends[i - 1] if i else None
        tails[i : i + 1], ends[i : i + 1] = [p[1]], [p]
    out, p = [], ends[-1] if ends else None
    while p is not None:
        out.append(p)
        p = back[p]
    return out[::-1]


def deletions(shared: list[tuple[int, int, int, int, bool, bool, int]], min_block_words: int) -> tuple[list[int], list[int]]:
    """Numbers of the long lines and of the gaps before long lines (-1: after the last) to delete.

    shared: (partner's id, partner's hash, k, partner's k, same gap before, same gap after, words).
    """
    partners: dict[tuple[int, int], dict[tuple[int, int], tuple]] = {}
    for s in shared:
        partners.setdefault((s[0], s[1]), {})[s[2], s[3]] = s
    lines, gaps = set(), set()
    for own in partners.values():
        block: list[tuple] = []
        for p in [*patience(list(own)), None]:
            s = own[p] if p else None
            if block and (s is None or (s[2], s[3]) != (block[-1][2] + 1, block[-1][3] + 1)):
                if sum(b[6] for b in block) >= min_block_words:
                    lines.update(b[2] for b in block)
                    gaps.update(b[2] for i, b in enumerate(block) if b[4] and (i or (b[2] == 0 and b[3] == 0)))
                    if block[-1][5]:
                        gaps.add(~block[-1][2])
                block = []
            if s is not None:
                block.append(s)
    return sorted(lines), sorted(gaps)


def cleaned(text: str, lines: set[int], gaps: set[int], spans: list[tuple[int, int]], min_words: int) -> tuple[str, int]:
    """The text without those long lines, gaps and runs, and how many non-empty lines went; ~k stands for the gap after line k, if k is the last."""
    every, long = split_lines(text, min_words)
    number = {i: k for k, (i, _) in enumerate(long)}
    within = {i for a, b in spans for i in range(a, b + 1)}
    out, k = [], 0
    for i, s in enumerate(every):
        if i in number:
            k = number[i] + 1
            gone = number[i] in lines
        else:
            gone = k in gaps or k == len(long) and ~(k - 1) in gaps
        if not (gone or i in within):
            out.append(s)
    left, had = (sum(1 for s in own if s and not s.isspace()) for own in (out, every))
    return "\n".join(out) if left else "", had - left


def pairs_of(lines: DataFrame, rare: int = RARE) -> DataFrame:
    """(doc, th, fd, ft, k, fk, sb, sa, w, to): what each document shares with an earlier one, its partner (fd, ft).

    Rare lines with every earlier holder, other lines and runs with the first one.
    """
    first = lines.groupBy("h").agg(F.min(F.struct("doc", "th", "k", "gb", "ga")).alias("f"), F.max(F.struct("doc", "th")).alias("l"), F.count("*").alias("n"))
    first = first.where((F.col("f.doc") != F.col("l.doc")) | (F.col("f.th") != F.col("l.th")))
    first = first.select("h", F.col("f.doc").alias("fd"), F.col("f.th").alias("ft"), F.col("f.k").alias("fk"), F.col("f.gb").alias("fgb"), F.col("f.ga").alias("fga"), "n")
    first = cut(first)  # so both sides of the join are shuffled and a line that very many documents hold can be split
    alone = F.col("to").isNotNull() | (F.col("n") > rare)
    same = [(F.col("gb") == F.col("fgb")).alias("sb"), (F.col("ga") == F.col("fga")).alias("sa")]
    with_first = lines.join(first, "h").where(alone & ((F.col("doc") != F.col("fd")) | (F.col("th") != F.col("ft"))))
    with_first = with_first.select("doc", "th", "fd", "ft", "k", "fk", *same, "w", "to")
    # at most RARE rows of a line meet
    few = lines.where("to is null").join(first.where(F.col("n") <= rare).select("h"), "h", "left_semi")
    few = few.groupBy("h").agg(F.collect_set(F.struct("doc", "th", "k", "gb", "ga", "w")).alias("m")).where(F.size("m") > 1)
    later = few.select("m", F.explode("m").alias("x"))
    earlier = F.filter("m", lambda y: F.struct(y["doc"], y["th"]) < F.struct(F.col("x.doc"), F.col("x.th")))
    both = later.select("x", F.explode(earlier).alias("y")).select(
        "x.doc", "x.th", F.col("y.doc").alias("fd"), F.col("y.th").alias("ft"), "x.k", F.col("y.k").alias("fk"), (F.col("x.gb") == F.col("y.gb")).alias("sb"), (F.col("x.ga") == F.col("y.ga")).alias("sa"), "x.w", F.lit(None).cast("int").alias("to")
    )
    return with_first.unionByName(both)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_block_words: int = MIN_BLOCK_WORDS, later_holders: bool = False, rare: int = RARE) -> DataFrame:
    """docs with text rewritten and the column removed_lines, the number of non-empty lines deleted.

    With later_holders, blocks of common long lines also go if only a later holder of the lines has them in that order.
    """
    lines = cut(lines_of(docs, min_words, min_block_words, later_holders))
    member = F.struct("fd", "ft", "k", "fk", "sb", "sa", "w")
    run = F.struct(F.col("k"), F.col("to"))
    grouped = pairs_of(lines, rare).groupBy("doc", "th").agg(F.collect_set(F.when(F.col("to").isNull(), member)).alias("shared"), F.collect_set(F.when(F.col("to").isNotNull(), run)).alias("spans"))  # at most RARE for each of the document's own lines

    @F.pandas_udf("struct<lines:array<int>,gaps:array<int>>")
    def chosen(shared: pd.Series) -> pd.DataFrame:
        found = [deletions([tuple(s.values()) for s in own], min_block_words) for own in shared]
        return pd.DataFrame({"lines": [f[0] for f in found], "gaps": [f[1] for f in found]})

    marks = grouped.select("doc", "th", chosen("shared").alias("c"), "spans").select("doc", "th", "c.lines", "c.gaps", "spans").where((F.size("lines") > 0) | (F.size("spans") > 0))
    names, own = docs.columns, plain(docs)
    at, width = place(names, "text"), len(names)
    joined = keyed(own, f"c{place(names, 'doc_id')}", f"c{at}").join(marks, ["doc", "th"], "left").select(*own.columns, "lines", "gaps", "spans")
    schema = joined.select(*own.columns).withColumn(f"c{at}", F.col(f"c{at}").cast("string")).withColumn("removed_lines", F.lit(0)).schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked, gaps, spans = (batch.column(width + i) for i in range(3))
            texts, removed = batch.column(at).cast(pa.string()), np.zeros(batch.num_rows, np.int32)
            hit = np.nonzero(marked.is_valid().to_numpy(zero_copy_only=False))[0].tolist()
            if hit:
                new = texts.to_pylist()
                for i in hit:
                    runs = [(x["k"], x["to"]) for x in spans[i].as_py()]
                    new[i], removed[i] = cleaned(new[i], set(marked[i].as_py()), set(gaps[i].as_py()), runs, min_words)
                texts = pa.array(new, pa.string())
            cols = list(batch.columns[:width])
            cols[at] = texts
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed)], names=schema.names)

    return given_back(joined.mapInArrow(rewrite, schema), names, ["removed_lines"])


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), later_holders=True).select("doc_id", "removed_lines", F.char_length("text").cast("long").alias("n_chars"), "text")


def without_copied_lines(docs: DataFrame) -> DataFrame:
    """docs with their texts rewritten, without those that were copies as a whole; n_chars follows the text. A column named removed_lines stays as it is."""
    names, own = docs.columns, plain(docs)
    c = lambda name: f"c{place(names, name)}"
    found = dedup_lines(own.withColumnsRenamed({c("doc_id"): "doc_id", c("text"): "text"}), later_holders=True).where((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    found = found.withColumnsRenamed({"doc_id": c("doc_id"), "text": c("text")})
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn(c("n_chars"), F.when(F.col("removed_lines") > 0, F.char_length(c("text")).cast(kind)).otherwise(F.col(c("n_chars"))))
    return given_back(found, names, [])
