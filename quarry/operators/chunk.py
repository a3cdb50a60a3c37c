"""Chunks: sentences packed up to a token budget, with breaks at headings, sections and topic shifts, and overlap.

A document's sentences are one ordered array, so packing is a fold inside a row: no shuffle, no group in Python state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions.text import context_header, sentences
from quarry.functions.vectors import hashed

UNIT = "struct<text:string,page:int,section:string,kind:string,hard_break:boolean>"
CHUNK = "struct<chunk_index:int,text:string,page:int,section:string,kind:string,tokens:int,overlap_sentences:int,sentences:int>"


def units(blocks: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, units): sentences of blocks in order; the first after a heading, and every table, is a hard break."""
    ordered = blocks.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("block_idx", "text", "page", "section", "kind"))).alias("b"))
    after = lambda i: (i > 0) & (F.try_element_at(F.col("b"), i)["kind"] == "heading")
    made = F.transform(
        "b",
        lambda b, i: F.when(b["kind"] == "heading", F.array().cast(f"array<{UNIT}>"))
        .when(b["kind"] == "table", F.array(F.struct(b["text"].alias("text"), b["page"].alias("page"), b["section"].alias("section"), b["kind"].alias("kind"), F.lit(True).alias("hard_break"))))
        .otherwise(F.transform(sentences(b["text"]), lambda s, j: F.struct(s.alias("text"), b["page"].alias("page"), b["section"].alias("section"), b["kind"].alias("kind"), F.coalesce((j == 0) & after(i), F.lit(False)).alias("hard_break")))),
    )
    return ordered.select(document, F.flatten(made).alias("units"))


def proxy(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3))


def cuts(sizes: list[int], breaks: list[bool], shifts: list[bool] | None, limit: int, least: int) -> list[int]:
    """Where groups begin, and the end: each reaches to the next break, to where the limit would be passed, or to the first shift
    beyond the least size, whichever comes first. All are found in running sums."""
    upto = np.cumsum([0, *sizes])
    stops = np.append(np.nonzero(breaks)[0], len(sizes))
    turns = np.nonzero(shifts)[0] if shifts is not None else np.zeros(0, np.int64)
    out, at = [0], 0
    while at < len(sizes):
        full = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, "right")) - 1)
        stop = int(stops[np.searchsorted(stops, at, "right")])
        enough = max(at + 1, int(np.searchsorted(upto, upto[at] + least)))
        turn = np.searchsorted(turns, enough)
        at = min(full, stop, int(turns[turn]) if turn < len(turns) else len(sizes))
        out.append(at)
    return out


def packed(sizes: list[int], breaks: list[bool], shifts: list[bool] | None, limit: int, least: int) -> list[list[int]]:
    """Positions in groups, as cuts() begins them."""
    at = cuts(sizes, breaks, shifts, limit, least)
    return [list(range(a, b)) for a, b in zip(at, at[1:])]


def _bounded(units: list[dict], starts: list[int], limit: int) -> tuple[list[dict], list[int]]:
    """The units, those over the limit cut by words, and where pieces begin: each part of a giant, what follows it, and each group."""
    out, heads, first = [], [], set(starts)
    alone = False
    for i, u in enumerate(units):
        words = u["text"].split() if proxy(u["text"]) > limit else None
        if words or alone or i in first:
            heads.append(len(out))
        if words:
            parts = [u | {"text": " ".join(words[a : a + limit])} for a in range(0, len(words), limit)]
            heads += range(len(out) + 1, len(out) + len(parts))
            out += parts
        else:
            out.append(u)
        alone = bool(words)
    return out, heads


def chunks_of(units: list[dict], limit: int, overlap: int, least: int, shifts: list[bool] | None = None) -> list[dict]:
    """Chunks of a document's units, in order."""
    if not units:
        return []
    breaks = [i > 0 and (u["hard_break"] or u["section"] != units[i - 1]["section"]) for i, u in enumerate(units)]
    one_group = shifts is not None and len(units) < 3
    starts = [0] if one_group else cuts([proxy(u["text"]) for u in units], breaks, shifts, limit, least)[:-1]
    parts, heads = _bounded(units, starts, limit)
    sizes = [proxy(u["text"]) for u in parts]
    pieces = cuts(sizes, [i in set(heads) for i in range(len(parts))], None, limit, 0)
    upto = np.cumsum([0, *sizes])
    ends = [pieces[0]]  # where chunks begin; a small piece goes to the chunk before it if section and room allow
    for a, b in zip(pieces, pieces[1:]):
        small = upto[b] - upto[a] < least and a > 0
        if not (small and parts[a]["section"] == parts[a - 1]["section"] and upto[b] - upto[ends[-1]] <= limit) and a:
            ends.append(a)
    out, before = [], None  # the bounds of the chunk before
    for a, b in zip(ends, [*ends[1:], len(parts)]):
        tail = a
        if before is not None and parts[before[1] - 1]["section"] == parts[a]["section"]:
            tail = max(before[0], int(np.searchsorted(upto, upto[before[1]] - overlap)))
            tail = min(tail, before[1])
        carried = parts[tail : before[1]] if before is not None and tail < a else []
        text = " ".join(u["text"] for u in [*carried, *parts[a:b]]).strip()
        if text:
            head = parts[a]
            out.append({"chunk_index": len(out), "text": text, "page": head["page"], "section": head["section"], "kind": head["kind"], "tokens": proxy(text), "overlap_sentences": len(carried), "sentences": b - a})
            before = (a, b)
    return out


def tail_of(units: list[dict], overlap: int) -> list[dict]:
    """The longest end of the units within the overlap budget."""
    upto = np.cumsum([0, *(proxy(u["text"]) for u in units)])
    return units[int(np.searchsorted(upto, upto[-1] - overlap)) :]


def embedded(docs: DataFrame) -> DataFrame:
    """docs with vectors, an embedding for each of units: sentences are rows while they are embedded."""
    rows = docs.select("document_id", F.posexplode("units").alias("i", "u")).select("document_id", "i", hashed(F.col("u.text")).alias("v"))
    made = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("document_id", F.col("s.v").alias("vectors"))
    return docs.join(made, "document_id", "left").withColumn("vectors", F.coalesce("vectors", F.array().cast("array<array<double>>")))


def chunk(docs: DataFrame, limit: int = SETTINGS.chunk_tokens, overlap: int = SETTINGS.overlap_tokens, least: int = SETTINGS.min_chunk_tokens, shifts: str | None = None) -> DataFrame:
    """docs with chunks (array of CHUNK) from units (array of UNIT) and, for semantic breaks, an array of booleans."""
    if limit <= overlap:
        raise ValueError("the chunk size must be over the overlap")

    given = docs.withColumn("_shifts", F.col(shifts) if shifts else F.lit(None).cast("array<boolean>"))
    schema = docs.withColumn("chunks", F.lit(None).cast(f"array<{CHUNK}>")).schema
    width, at = len(docs.columns), docs.columns.index("units")
    kind = pa.list_(pa.struct([(n, pa.string() if n in ("text", "section", "kind") else pa.int32()) for n in (x.split(":")[0] for x in CHUNK[7:-1].split(","))]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [chunks_of(u.as_py() or [], limit, overlap, least, s.as_py()) for u, s in zip(batch.column(at), batch.column(width), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(made, kind)], names=[*batch.schema.names[:width], "chunks"])

    return given.mapInArrow(pack, schema)


def groups(docs: DataFrame, limit: int = SETTINGS.chunk_tokens) -> DataFrame:
    """docs with groups: the group of each unit when they are packed up to the limit, with breaks at headings and sections."""

    @F.pandas_udf("array<int>")
    def pack(column: pd.Series) -> pd.Series:
        out = []
        for u in column:
            u = list(u) if u is not None else []
            breaks = [i > 0 and (x["hard_break"] or x["section"] != u[i - 1]["section"]) for i, x in enumerate(u)]
            out.append([g for g, own in enumerate(packed([proxy(x["text"]) for x in u], breaks, None, limit, 0)) for _ in own])
        return pd.Series(out)

    return docs.withColumn("groups", pack("units"))


def topic_shifts(vectors: Column, percentile: float = SETTINGS.breakpoint_percentile) -> Column:
    """For each vector of an ordered array, whether it is further from the one before than the percentile of all steps (to nine digits)."""

    @F.pandas_udf("array<boolean>")
    def shifts(column: pd.Series) -> pd.Series:
        out = []
        for own in column:
            if own is None or len(own) < 2:
                out.append([False] * (0 if own is None else len(own)))
                continue
            v = np.stack([np.asarray(x, np.float64) for x in own])
            norm = np.linalg.norm(v, axis=1)
            scale = norm[1:] * norm[:-1]
            steps = np.round(1 - np.where(scale == 0, 0.0, (v[1:] * v[:-1]).sum(axis=1) / np.where(scale == 0, 1, scale)), 9)
            out.append([False, *(steps > np.round(np.quantile(steps, percentile), 9)).tolist()])
        return pd.Series(out)

    return shifts(vectors)


def with_headers(chunks: DataFrame) -> DataFrame:
    """Adds embed_text: the chunk under its context header (columns title, section, page, text)."""
    return chunks.withColumn("embed_text", F.concat_ws("\n", context_header(F.col("title"), F.col("section"), F.col("page")), F.col("text")))


def pages_units(pages: Column) -> Column:
    """Units of a document given as an array of page texts: each page that isn't blank is one block of text."""
    of = lambda p, i: F.transform(sentences(p), lambda s: F.struct(s.alias("text"), (i + 1).cast("int").alias("page"), F.lit("").alias("section"), F.lit("text").alias("kind"), F.lit(False).alias("hard_break")))
    return F.flatten(F.transform(pages, of)).cast(f"array<{UNIT}>")
