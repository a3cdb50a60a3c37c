"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints link at a Hamming distance of at most r. Each bit position gets an index in 1 .. 2^(r+1)-1; table v (also
1 .. 2^(r+1)-1) keeps the positions whose index has an odd scalar product with v over GF(2). Any r positions span
at most r dimensions, so some v is orthogonal to all of them: the pair agrees on all that table v keeps, and every
pair within the radius meets in some table. Equal fingerprints are one node, so copies are never expanded.

A bucket of up to LIGHT fingerprints is compared in full inside one row. A larger one is refined: the same covering is
laid over the bits its table left out, so its fingerprints meet again in smaller buckets, until at most 8 bits are
free (at most 256 distinct fingerprints). No bucket is ever cut off or gathered beyond that bound.

dedup() groups texts by the Jaccard similarity of their shingles. Fingerprints of weighted words propose pairs: within the
radius all are linked, up to a longer reach those that meet. What they leave out, as Hamming distance doesn't bound
similarity, is completed exactly: every two similar texts share a shingle of their prefixes.

Defined cases: a null or empty text has no word and gets fingerprint zero, which links like any other; fewer words
than a shingle give one shingle of all words; repeated rows keep their rows and share a component; a null id counts as
no candidate for the smallest id, and a component of null ids alone has a null id. Extra columns are ignored by
near_groups(), and stay as they are in dedup(), whatever their names; its cases are given there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import arrow_batches, cut, given_back, place, plain, table
from .components import components, extended
from .words import LOWER, MIX, SEED, slices, words_of

LIGHT = 256  # fingerprints compared in full in one row
HEAVY = 16  # bytes of a word that weighs most in the fingerprints of dedup()
LAST = 2**63 - 1
SAMPLE, COMMON, MOST_COMMON = 16, 8, 100_000  # one text of so many is sampled; texts there that make a shingle common; the most that are listed
BITS = 4096  # of a text, that rule out most pairs before their shingles are compared
FOLDS = ["s0", "s1", "s2", "s3"]  # the same bits folded into 256, that rule out most pairs as they meet


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each shingle of a text; A-Z are lower-cased, words are separated by the six ASCII white spaces."""
    words = text.translate(LOWER).split()  # bytes.split() splits at exactly x20 and x09-x0D
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majorities(hashes: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The fingerprints of n texts: bits set in over half of the weight of a text's hashes (uint64); zero if there are none."""
    total = np.bincount(owner, weights, n)
    out = np.zeros(n, np.uint64)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    for k in range(8):
        byte = ((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        votes = np.bincount(owner * 256 + byte, weights, n * 256).reshape(n, 256) @ bits
        out |= np.packbits(2 * votes > total[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def majority(hashes: list[int]) -> int:
    return int(majorities(np.array(hashes, np.uint64), np.zeros(len(hashes), np.int64), 1)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, th, fp): a hash of every whole text and its fingerprint, as signed longs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(text).alias("th"), text.alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for a, raw, at in slices(batch.column(2)):
                data, ends, n = raw.tobytes(), at.tolist(), len(at) - 1
                hashes = [np.array(shingle_hashes(data[i:j], size), np.uint64) for i, j in zip(ends, ends[1:])]
                fps[a : a + n] = majorities(np.concatenate(hashes), np.repeat(np.arange(n), [len(h) for h in hashes]), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64), pa.int64())], names=[id_col, "th", "fp"])

    return arrow_batches(base).mapInArrow(each, f"{id_col} long, th long, fp long")


def covering(positions: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """(mask, positions left out) of each table: any radius of the positions all lie outside some table's mask."""
    top = 2 ** (radius + 1)
    index = {p: i % (top - 1) + 1 for i, p in enumerate(positions)}
    out = []
    for v in range(1, top):
        kept = [p for p in positions if (index[p] & v).bit_count() % 2]
        out.append((sum(1 << p for p in kept), [p for p in positions if p not in set(kept)]))
    return out


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def _pairs(radius: int, reach: int):
    """Links of one bucket. Within the radius they connect all that is near; up to a longer reach, which only proposes pairs
    to be verified, each member is linked with its nearest and with the smallest within the radius and within the reach."""

    def ends(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.bitwise_count(u.view(np.uint64)[:, None] ^ u.view(np.uint64)[None, :])
        if reach > radius:
            first, near = (far <= reach).argmax(axis=1), (far <= radius).argmax(axis=1)
            every = np.arange(len(u))
            apart = far.copy()
            np.fill_diagonal(apart, 65)
            x, y = np.concatenate((apart.argmin(axis=1), near, first)), np.tile(every, 3)
            keep = (x != y) & (far[x, y] <= reach)
            return np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        near = far <= radius
        x, y = np.nonzero(np.triu(near, 1))
        # a link that two links through a smaller member already give is left out: the component stays the same
        first = np.argmax(near, axis=1)
        keep = (x == first[y]) | ~near[first[y], x]
        return x[keep], y[keep]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            at, fps = members.offsets.to_numpy(), members.values.to_numpy()
            found = [np.zeros((0, 2), np.int64)]
            for i, j in zip(at.tolist(), at[1:].tolist()):
                u = fps[i:j]
                x, y = ends(u)
                found.append(np.stack((u[x], u[y]), axis=1))
            flat = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

    return linked


def links(prints: DataFrame, radius: int = 2, light: int | None = None, reach: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints.

    They connect exactly those within the radius, directly or in steps. With a longer reach they are proposals: beside
    those within the radius, the pairs up to the reach that happen to meet, thinned out as _pairs says.
    """
    rows = prints.select("fp").distinct().withColumn("path", F.lit(0))
    free, fixed, taken = {0: list(range(64))}, {0: 0}, 0  # by path, the number of a table: the bits it leaves out, the mask of the others
    light = LIGHT if light is None else light
    linked, found = _pairs(radius, reach or radius), None
    while free:
        last = all(len(p) <= 8 for p in free.values())
        if last:
            masks, left, below = dict(fixed), dict(free), {path: [path] for path in free}
        else:
            masks, left, below = {}, {}, {}
            for path, positions in free.items():
                below[path] = []
                for mask, out in covering(positions, radius):
                    taken += 1
                    masks[taken], left[taken] = fixed[path] | mask, out
                    below[path].append(taken)
        # constant arrays, so that exploding them makes no object a row
        least = min(masks)
        table_masks = F.array(*[F.lit(_signed(masks.get(t, 0))) for t in range(least, max(masks) + 1)])
        choose = None
        for path, tables in below.items():
            own = F.array(*[F.lit(t) for t in tables])
            choose = own if choose is None else F.when(F.col("path") == path, own).otherwise(choose)
        keyed = rows.select("fp", F.explode(choose).alias("path"))
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.element_at(table_masks, F.col("path") - (least - 1))))
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = keyed.join(sizes, ["path", "key"])
        whole = shared if last else shared.where(F.col("n") <= light)
        now = whole.groupBy("path", "key").agg(F.sort_array(F.collect_list("fp")).alias("members"))
        now = cut(arrow_batches(now.select("members")).mapInArrow(linked, "a long, b long").distinct())
        found = now if found is None else found.unionByName(now)
        if last:
            break
        rows = cut(shared.where(F.col("n") > light).select("fp", "path").distinct())
        seen = {r[0] for r in rows.select("path").distinct().collect()}  # tables in use: bounded by the covering
        free, fixed = {t: p for t, p in left.items() if t in seen}, {t: m for t, m in masks.items() if t in seen}
    return found


def near_groups(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id that links reach."""
    prints = cut(fingerprints(docs, size))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(links(prints, radius))
    roots = least.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by the similarity of shingles ----------------------------------------------------------------


def shingles_of(words: np.ndarray, owner: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of n rows' words, by row; fewer words than size make one shingle."""
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts)
    at = np.arange(len(words))
    length = np.minimum(ends[owner] - at, size)  # words that are left for a shingle
    here = (length == size) | (at == ends[owner] - counts[owner])
    at, length, owner = at[here], length[here], owner[here]
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        own = length > j
        x = (h[own] ^ words[at[own] + j]) * MIX[j % 5]
        h[own] = x ^ (x >> np.uint64(31))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new].view(np.int64), owner[new]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int64()))


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(th, s): the distinct hashes of the shingles of rows' texts (columns th and text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, raw, at in slices(batch.column(1)):
                n = len(at) - 1
                h, owner = shingles_of(*words_of(raw, at)[:2], n, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), _lists(h, np.bincount(owner, minlength=n))], names=["th", "s"])

    return arrow_batches(rows.select("th", "text")).mapInArrow(each, "th long, s array<long>")


def alike(base: DataFrame, texts: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): the pairs (x, y) of texts whose shingles have a Jaccard similarity of at least similarity; base has id, th and text."""
    asked = pairs.select(F.col("x").alias("th")).unionByName(pairs.select(F.col("y").alias("th"))).distinct().join(texts, "th").select("id", "th")
    rows = base.join(asked, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    sets = cut(shingle_sets(rows, size))
    both = pairs.join(sets.select(F.col("th").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("th").alias("y"), F.col("s").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    near = (F.size("sx") + F.size("sy") == 0) | (shared >= similarity * (F.size("sx") + F.size("sy") - shared))
    return cut(both.where(near).select(F.col("x").alias("a"), F.col("y").alias("b")))


def read_words(base: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, th, fp, n, toks, bits, s0 to s3) of the rows of base (id, th, text), in one reading of the texts.

    fp is the fingerprint of the words: a word weighs the cube of its bytes (of HEAVY at most), so the few short words of a
    language don't crowd it. toks are, of the text's n shingles, the first in one order for all texts, so many that two texts of at
    least the similarity share one of them: a text has similarity * n shingles in common with the other, and all but fewer are
    here; any order does, and shingles that are common in a sample come last, so that few texts meet by a common passage. bits
    say of BITS places whether an odd number of shingles fall on it, s0 to s3 the same of 256 places.
    """
    some = shingle_sets(base.where(F.pmod("th", F.lit(SAMPLE)) == 0), size).select("th", F.explode("s").alias("tok")).distinct()
    common = some.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.col("n").desc(), "tok").limit(MOST_COMMON).collect()
    common = sorted((r[0], r[1]) for r in common)
    known, often = np.array([c[0] for c in common], np.int64), np.array([c[1] for c in common], np.int64)
    names = ["id", "th", "fp", "n", "toks", "bits", *FOLDS]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, raw, at in slices(batch.column(2)):
                n = len(at) - 1
                words, owner, length, _ = words_of(raw, at)
                fps = majorities(words, owner, n, np.minimum(length, HEAVY).astype(np.float64) ** 3)
                h, owner = shingles_of(words, owner, n, size)
                counts = np.bincount(owner, minlength=n)
                odd = (np.bincount(owner * BITS + (h & (BITS - 1)), minlength=n * BITS) & 1).astype(bool).reshape(n, BITS)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    order = np.lexsort((h, np.where(known[at] == h, often[at], 0), owner))
                    h = h[order]
                rank = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
                prefix = counts - np.ceil(similarity * counts - 1e-6).astype(np.int64) + 1
                kept = rank < prefix[owner]
                toks, sizes = h[kept], np.minimum(prefix, counts)
                if (counts == 0).any():  # texts without a word are alike: they share a token
                    toks = np.insert(toks, np.repeat((np.cumsum(sizes) - sizes)[counts == 0], 1), 0)
                    sizes = np.where(counts == 0, 1, sizes)
                packed = np.packbits(odd, axis=1)
                folds = np.bitwise_xor.reduce(packed.reshape(n, -1, 32), axis=1).view(np.int64)
                columns = [pa.array(fps.view(np.int64), pa.int64()), pa.array(counts, pa.int32()), _lists(toks, sizes), pa.array([p.tobytes() for p in packed], pa.binary()), *(pa.array(f) for f in folds.T)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), *columns], names=names)

    return arrow_batches(base.select("id", "th", "text")).mapInArrow(each, "id long, th long, fp long, n int, toks array<long>, bits binary, " + ", ".join(f"{c} long" for c in FOLDS))


def possible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) that may have the similarity: shingles that only one of two texts has are at least as many as bits that differ."""
    both = pairs.join(texts.select(F.col("th").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx")), "x").join(texts.select(F.col("th").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by")), "y")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bx, by = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (4, 5))
            apart = np.bitwise_count(bx ^ by).sum(axis=1, dtype=np.int64)
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = pa.array(apart <= (1 - similarity) / (1 + similarity) * n + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    return arrow_batches(both.select("x", "y", "nx", "ny", "bx", "by")).mapInArrow(each, "x long, y long")


def rooted(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """rows (of texts th) with root, their component in tree."""
    return rows.join(tree.withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))


def meeting(rows: DataFrame) -> DataFrame:
    """rows (tok, th, n, p, root) where texts of different components share a token; p is its place in the text's order."""
    mixed = rows.groupBy("tok").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("tok")
    return cut(rows.join(mixed, "tok", "left_semi"))


def _sized(pairs: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs of texts x < y of pairs of rows x and y that may have the similarity by their numbers of shingles, their
    folded bits (as in possible()) and the places of a token that they share: if it is the first that they share, no more are
    common than follow in either text, and every similar pair passes by its first."""
    n = F.col("x.n") + F.col("y.n")
    common = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in FOLDS[1:]), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    fit = pairs.where((F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6) & (common >= similarity / (1 + similarity) * n - 1e-6) & (apart <= (1 - similarity) / (1 + similarity) * n + 1e-6))
    return fit.select(F.least("x.th", "y.th").alias("x"), F.greatest("x.th", "y.th").alias("y")).distinct()


def to_largest(rows: DataFrame, similarity: float) -> DataFrame:
    """(x, y): for each token of rows (as meeting() gives them) a text of each component with one of the component that has most of
    its texts; other tokens take other texts. A pair a component and token, so these merge what is dense at little cost."""
    early = F.floor(20 * F.col("p") / F.greatest("n", F.lit(1)))  # early tokens leave room for many common ones
    some = rows.groupBy("tok", "root").agg(F.count("*").alias("m"), F.min(F.struct(early.alias("e"), F.xxhash64("th", "tok").alias("r"), "th", "n", "p", *FOLDS)).alias("t"))
    hub = some.groupBy("tok").agg(F.max(F.struct("m", "root", "t")).alias("h"))
    met = some.join(hub, "tok").where(F.col("root") != F.col("h.root"))
    return _sized(met.select(F.col("t").alias("x"), F.col("h.t").alias("y")), similarity)


def unmet(rows: DataFrame, similarity: float) -> DataFrame:
    """(x, y): all pairs of texts in different components that share a token and that _sized() allows."""
    # components meet before their texts do, so a group of near copies is never paired with itself
    roots = cut(rows.select("tok", "root").distinct())
    met = roots.withColumnRenamed("root", "ra").join(roots.withColumnRenamed("root", "rb"), "tok").where("ra < rb")
    row = F.struct("th", "n", "p", *FOLDS)
    met = met.join(rows.select("tok", F.col("root").alias("ra"), row.alias("x")), ["tok", "ra"])
    met = met.join(rows.select("tok", F.col("root").alias("rb"), row.alias("y")), ["tok", "rb"])
    return cut(_sized(met, similarity))


def dedup(docs: DataFrame, radius: int = 3, size: int = 5, similarity: float = 0.8, reach: int = 8) -> DataFrame:
    """docs without the near-duplicates: one document of each group stays, that of the smallest id.

    Texts are near if their shingles of size words have a Jaccard similarity of at least similarity (two texts without
    a word are alike). The covering tables propose pairs by the fingerprints of the texts' words: all within the radius are
    connected, and each text is compared with the nearest and the smallest that it meets up to the reach. That leaves
    some out, so the groups so far are completed by the prefixes of the texts' shingles, which every pair of the
    similarity shares: first each group meets the largest one at each shingle, then all pairs that meet there and still aren't in
    one group are compared.

    Equal texts are one node. Ids that are null come last; of documents of one id the smaller hash of the text comes first,
    so a group keeps one of them; rows equal in id and text are one document, of which the row with the smallest hash of all
    columns stays.
    """
    names, own = docs.columns, plain(docs)
    c = lambda name: F.col(f"c{place(names, name)}")
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    own = own.withColumns({"id": F.coalesce(c("doc_id").cast("long"), F.lit(LAST)), "th": F.xxhash64(text), "text": text})
    base = own.select("id", "th", "text")
    found = read_words(base, size, similarity)
    texts = cut(found.groupBy("th").agg(F.min("id").alias("id"), *[F.any_value(n).alias(n) for n in ("fp", "n", "toks", "bits", *FOLDS)]))
    heads = cut(texts.groupBy("fp").agg(F.min(F.struct("id", "th"))["th"].alias("head")))
    twins = texts.select("th", "fp").join(heads, "fp").where("th <> head").select(F.col("th").alias("x"), F.col("head").alias("y"))
    near = links(heads, radius, reach=reach)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    pairs = twins.unionByName(near.select("x", "y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = cut(possible(pairs.distinct(), texts, similarity))
    ids = texts.select("id", "th")
    tree = cut(components(alike(base, ids, pairs, size, similarity)))
    rows = None
    for propose in (to_largest, unmet):
        if rows is None:
            rows = rooted(texts.select("th", "n", "toks", *FOLDS), tree).select(F.posexplode("toks").alias("p", "tok"), "th", "n", "root", *FOLDS)
        else:
            rows = rooted(rows.drop("root"), tree)  # what once met in one component does so for good
        rows = meeting(rows.select("tok", "th", "n", "p", "root", *FOLDS))
        more = cut(possible(propose(rows, similarity).join(pairs, ["x", "y"], "left_anti"), texts, similarity))
        pairs = pairs.unionByName(more)
        tree = cut(extended(tree, alike(base, ids, more, size, similarity)))
    groups = ids.join(tree.withColumnRenamed("node", "th"), "th", "left").groupBy(F.coalesce("root", "th").alias("group")).agg(F.min(F.struct("id", "th")).alias("k"))
    kept = own.join(groups.select("k.id", "k.th"), ["id", "th"], "left_semi")
    columns = [f"c{i}" for i in range(len(names))]
    hashed = [n for n in columns if not isinstance(own.schema[n].dataType, (MapType, VariantType))]
    one = kept.groupBy("id", "th").agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("row"))
    return given_back(one.select("row.*"), names, [])
