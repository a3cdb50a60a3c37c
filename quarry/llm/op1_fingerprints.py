"""Document fingerprints: SimHash with permuted block tables, in DataFrame functions only.

A term is a pair of neighbouring words (the last word pairs with nothing), weighted by how often it occurs. Each
occurrence votes with the bits of its 64-bit hashes; a bit is set if over half of the votes set it. Votes are
counted two bits to a long (32 bits each), so one grouped sum needs 32 columns for 64 bits and no shuffle
of its own: the rows are already dealt by document.

Defined cases: a null or empty text, or one of white space, has no term and gets fingerprint zero; equal texts get
equal fingerprints; a null id sorts before all others; rows that repeat an id keep their own fingerprints, and as the
next document they are represented by their smallest text; one document alone is its own next.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WORDS = 2  # 64-bit words in a fingerprint
SPACE = r"[\x20\x09-\x0D]+"
PAIR = 0x0000000100000001
LOWEST = -(2**63)


def _word(name: str, votes: Column) -> Column:
    """The 64-bit word whose bits have over half of the votes."""
    out = F.lit(0).cast("long")
    for i in range(32):
        s = F.coalesce(F.col(f"{name}_{i}"), F.lit(0))
        out = out.bitwiseOR(F.when(F.lit(2) * s.bitwiseAND(0xFFFFFFFF) > votes, F.lit(1 << i)).otherwise(F.lit(0)))
        high = 1 << (i + 32) if i < 31 else LOWEST
        out = out.bitwiseOR(F.when(F.lit(2) * F.shiftright(s, 32) > votes, F.lit(high).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def simhash(rows: DataFrame, keys: list[str], text: str, words: int = WORDS) -> DataFrame:
    """keys and f0, f1, ...: the fingerprint of each row's text; rows of equal keys count as one."""
    w = F.array_remove(F.split(F.lower(F.col(text)), SPACE), "")
    listed = rows.select(*keys, w.alias("_w"))
    zipped = listed.select(*keys, F.when(F.size("_w") > 0, F.expr("arrays_zip(_w, concat(slice(_w, 2, greatest(size(_w) - 1, 0)), array('')))")).alias("_t"))
    terms = zipped.select(*keys, F.explode_outer("_t").alias("_t"))
    h0 = terms.select(*keys, F.when(F.col("_t").isNotNull(), F.xxhash64(F.col("_t").getField("_w"), F.col("_t").getField("1"))).alias("h0"))
    hashed = h0.select(*keys, "h0", *[F.xxhash64("h0", F.lit(k)).alias(f"h{k}") for k in range(1, words)])
    sums = [F.sum(F.shiftright(f"h{k}", i).bitwiseAND(PAIR)).alias(f"s{k}_{i}") for k in range(words) for i in range(32)]
    voted = hashed.groupBy(*keys).agg(F.count("h0").alias("votes"), *sums)
    return voted.select(*keys, *[F.when(F.col("votes") > 0, _word(f"s{k}", F.col("votes"))).otherwise(F.lit(0).cast("long")).alias(f"f{k}") for k in range(words)])


def text_of(names: list[str]) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])


def differing(a: list[str], b: list[str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))))


def likeness(a: list[str], b: list[str]) -> Column:
    return F.lit(1.0) - differing(a, b) / F.lit(float(64 * len(a)))


def successors(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next_key): each distinct id's next greater one, the smallest after the greatest.

    The ids alone are dealt out by range; only the first id of each range meets in one task.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.select(key).distinct().repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()))
    w = Window.orderBy("_range")
    heads = ranged.groupBy("_range").agg(F.min(key).alias("_first"))
    heads = heads.select("_range", F.coalesce(F.lead("_first").over(w), F.min("_first").over(Window.partitionBy())).alias("_after"))
    inside = ranged.withColumn("_next", F.lead(key).over(Window.partitionBy("_range").orderBy(key)))
    return inside.join(F.broadcast(heads), "_range").select(key, F.coalesce("_next", "_after").alias(f"next_{key}"))


def block_tables(radius: int, blocks: int, words: int = WORDS) -> list[list[int]]:
    """For each choice of blocks - radius blocks, the masks of its bits: two fingerprints within the radius agree on one."""
    total, edges = 64 * words, [64 * words * i // blocks for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        out.append([(m := (mask >> (64 * k)) & (2**64 - 1)) - (2**64 if m >> 63 else 0) for k in range(total // 64)])
    return out


def within_radius(queries: DataFrame, index: DataFrame, names: list[str], radius: int = 3, blocks: int = 5) -> DataFrame:
    """(q_*, names): all pairs of distinct fingerprints of queries and index that differ in at most radius bits.

    Every fingerprint goes to each permuted table under its chosen blocks; pairs that meet are compared in full.
    """
    masks = block_tables(radius, blocks, len(names))

    def keyed(df: DataFrame, prefix: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[F.col(n).bitwiseAND(F.lit(m)) for n, m in zip(names, mask, strict=True)]).alias("key")) for t, mask in enumerate(masks)])
        return df.select(*names).distinct().select(*[F.col(n).alias(prefix + n) for n in names], F.explode(rows).alias("_k")).select("*", "_k.table", "_k.key").drop("_k")

    met = keyed(queries, "q_").join(keyed(index, "i_"), ["table", "key"])
    q, i = [f"q_{n}" for n in names], [f"i_{n}" for n in names]
    return met.where(differing(q, i) <= radius).select(*q, *i).distinct()


def fingerprint_documents(docs: DataFrame, radius: int = 3, blocks: int = 5, query_every: int = 100) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and for every id divisible by query_every the
    number of documents (itself included) within the radius, from the block tables."""
    names, edited = [f"f{k}" for k in range(WORDS)], [f"e{k}" for k in range(WORDS)]
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    after = successors(base)
    lengths = base.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    wanted = after.join(lengths, "doc_id").select(F.col("doc_id").alias("prev"), F.col("next_doc_id").alias("doc_id"), F.expr("n div 4").alias("k"))
    heads = base.join(wanted, "doc_id").select(F.col("prev").alias("doc_id"), F.expr("substring(text, 1, k)").alias("head")).groupBy("doc_id").agg(F.min("head").alias("head"))
    both = base.join(heads, "doc_id").withColumn("n", F.char_length("text")).withColumn("k", F.expr("n div 4"))
    both = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), "text", F.expr("concat(substring(text, 1, n - k), substring(head, 1, k))").alias("edited"))
    both = both.withColumn("row", F.xxhash64("text", "edited"))
    each = both.select("doc_id", "row", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v")).select("doc_id", "row", "v.which", "v.text")
    votes = simhash(each, ["doc_id", "row", "which"], "text")
    pivoted = votes.groupBy("doc_id", "row").agg(*[F.max(F.when(F.col("which") == w, F.col(f"f{k}"))).alias(f"{p}{k}") for w, p in enumerate("fe") for k in range(WORDS)])
    plain = both.select("doc_id", "row", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    prints = cut(plain.join(pivoted, ["doc_id", "row"]))  # one job, so the texts are dealt out by document once
    nexts = prints.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("s")).select(F.col("doc_id").alias("next_doc_id"), *[F.col(f"s.f{k}").alias(f"n{k}") for k in range(WORDS)])
    found = prints.join(after.join(nexts, "next_doc_id"), "doc_id")
    counted = prints.groupBy(*names).agg(F.count("*").alias("held"))
    asked = prints.where((F.col("doc_id") != LOWEST) & (F.col("doc_id") % query_every == 0)).select(*names)
    near = within_radius(asked, counted, names, radius, blocks)
    near = near.join(counted.select(*[F.col(n).alias(f"i_{n}") for n in names], "held"), [f"i_{n}" for n in names])
    near = near.groupBy(*[f"q_{n}" for n in names]).agg(F.sum("held").alias("n_within")).select(*[F.col(f"q_{n}").alias(n) for n in names], "n_within")
    found = found.join(near, names, "left")
    isq = F.col("doc_id").isNotNull() & (F.col("doc_id") % query_every == 0)
    found = found.withColumn("doc_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text_of(names).alias("fingerprint"), text_of(edited).alias("edited_fingerprint"),
        likeness(names, edited).alias("near_edited"), likeness(names, [f"n{k}" for k in range(WORDS)]).alias("near_next"),
        F.when(isq, F.col("n_within")).alias("n_within"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
