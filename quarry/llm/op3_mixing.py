"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to a power alpha and normalised. Alpha starts at 1 (the natural mixture)
and is bisected down to the largest value whose entropy reaches the target, a share of the logarithm of the number of
sources, as far as no source is then repeated more often than the limit: if it would be, alpha rises to the least
value that keeps the limit. The weights times the budget are realised as block permutations: a source's
documents fall into blocks by a hash, whole epochs take every document, and the rest takes blocks in permuted order
and, within the last block, documents in permuted order, while their tokens fit.

The driver fetches no source, only how many sources there are of each number of tokens. Running sums are taken over the
blocks of a source (at most BLOCKS) and over the documents of one block, so no source meets in one task.

Defined cases: a null source is a source of its own; a null or empty text has no token and is drawn with every epoch,
or at its place in the permutation; rows that repeat an id are drawn alike, ties go to the smaller text; without
tokens every weight is 0 and nothing is drawn. Extra columns stay as they are; those named n_tokens, weight or epoch give
way to the results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, given_back, id_text, place, plain, table

ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
BLOCKS = 4096
SEED = 20
STEPS = 60
MANY_SOURCES = 100_000  # up to which the row a source is broadcast


def entropy(p: list[float], times: list[int] | None = None) -> float:
    return -math.fsum(n * x * math.log(x) for x, n in zip(p, times or [1] * len(p), strict=True) if x > 0)


def tempered(shares: list[float], alpha: float, times: list[int] | None = None) -> list[float]:
    """The shares raised to alpha and normalised; times says how many sources have each share."""
    raised = [x**alpha if x > 0 else 0.0 for x in shares]
    total = math.fsum(x * n for x, n in zip(raised, times or [1] * len(raised), strict=True))
    return [x / total for x in raised] if total else [0.0] * len(shares)


def bisected(good, lo: float, hi: float) -> float:
    """The end of the good values: good(lo) holds and good(hi) doesn't."""
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return lo


def temperature(tokens: list[int], budget: float, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, times: list[int] | None = None) -> float:
    """The exponent for sources of so many tokens; times says how many sources have each number."""
    times = times or [1] * len(tokens)
    total = sum(t * n for t, n in zip(tokens, times, strict=True))
    shares = [t / total for t in tokens] if total else []
    some = sum(n for t, n in zip(tokens, times, strict=True) if t > 0)
    if some < 2:
        return 1.0
    wanted = entropy_share * math.log(some)
    flat = lambda a: entropy(tempered(shares, a, times), times) >= wanted
    fits = lambda a: all(w * budget <= max_repeats * t for w, t in zip(tempered(shares, a, times), tokens, strict=True) if t)
    alpha = 1.0 if flat(1.0) else bisected(flat, 0.0, 1.0)
    if not fits(alpha) and fits(1.0):
        alpha = 1 - bisected(lambda b: fits(1 - b), 0.0, 1 - alpha)
    return alpha


def _place(*parts) -> F.Column:
    """A number below 2^32 from a hash of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def _measured(docs: DataFrame, doc_id: str, text_col: str, source_col: str) -> DataFrame:
    """docs with source_, n_tokens (words), place (of its block in the source's permutation, and the block) and at (of
    the document in its block)."""
    text, name = F.coalesce(F.col(text_col).cast("string"), F.lit("")), id_text(doc_id)
    rows = docs.withColumn("source_", F.col(source_col).cast("string")).withColumn("n_tokens", F.regexp_count(text, F.lit(r"\S+")).cast("long")).withColumn("b", _place(F.lit("b"), name) % BLOCKS)
    block = F.struct(_place(F.lit("p"), F.coalesce("source_", F.lit("")), F.col("b").cast("string")).alias("p"), F.col("b").alias("b"))
    at = F.struct(_place(F.lit("d"), name).alias("d"), name.alias("i"), F.md5(text).alias("t"))
    return rows.withColumn("place", block).withColumn("at", at).drop("b")


def mixture(docs: DataFrame, keep: list[str] | None = None, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, source_col: str = "source") -> DataFrame:
    """The columns to keep (all if None), n_tokens (words), weight (of the source) and epoch (from 1): a row of docs for
    each time it is drawn. The budget in tokens is that of docs by default."""
    keep = docs.columns if keep is None else keep
    bare = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("words"), F.col(source_col).alias("from"))
    small = cut(_measured(bare, "doc", "words", "from").select("source_", "n_tokens", "place", "at", "doc", "from"))
    per = cut(small.groupBy("source_").agg(F.sum("n_tokens").alias("t")))
    counted = per.groupBy("t").agg(F.count("*").alias("n")).orderBy("t").collect()
    tokens, times = [r["t"] for r in counted], [r["n"] for r in counted]
    total, sources = sum(t * n for t, n in zip(tokens, times, strict=True)), sum(times)
    budget = total if budget is None else budget
    alpha = temperature(tokens, budget, entropy_share, max_repeats, times)
    whole = math.fsum(n * (t / total) ** alpha for t, n in zip(tokens, times, strict=True) if t) or 1.0
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(total or 1)), F.lit(alpha)) / F.lit(whole)).otherwise(0.0)
    drawn = F.floor(F.col("weight") * F.lit(float(budget)) + 0.5)
    quota = per.withColumn("weight", weight).select(F.col("source_").alias("q"), "weight", *[F.when(F.col("t") > 0, e).otherwise(0).alias(n) for e, n in ((F.floor(drawn / F.col("t")), "epochs"), (drawn % F.col("t"), "rest"))])
    ruled = lambda df, other: df.join(F.broadcast(other) if sources <= MANY_SOURCES else other, df["source_"].eqNullSafe(other["q"]))
    # the block in which a source's rest ends: the first of the permutation that doesn't fit as a whole
    blocks = small.groupBy("source_", "place").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source_").orderBy("place"))
    blocks = ruled(blocks.withColumn("upto", upto), quota).where(F.col("upto") > F.col("rest"))
    ending = blocks.groupBy("q", "weight", "epochs", "rest").agg(F.min(F.struct("place", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
    ending = cut(ending.select("q", "weight", "epochs", "rest", F.col("e.place").alias("last"), F.col("e.before").alias("before")))
    # the document of that block with which the rest ends
    inside = ruled(small, ending).where(F.col("place") == F.col("last"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source_").orderBy("at")))
    reached = inside.where(F.col("upto") <= F.col("rest")).groupBy(F.col("q").alias("r")).agg(F.max("at").alias("reach"))
    rule = cut(ending.join(reached, F.col("q").eqNullSafe(F.col("r")), "left").drop("r"))
    extra = (F.col("place") < F.col("last")) | ((F.col("place") == F.col("last")) & F.coalesce(F.col("at") <= F.col("reach"), F.lit(False)))
    if set(keep) <= {"doc_id", source_col}:
        names, base = keep, small.select(*[F.col("doc" if k == "doc_id" else "from").alias(f"c{i}") for i, k in enumerate(keep)], "source_", "n_tokens", "place", "at")
    else:
        names, of = docs.columns, lambda name: f"c{place(docs.columns, name)}"
        base = _measured(plain(docs), of("doc_id"), of("text"), of(source_col))
    found = ruled(base, rule).withColumn("copies", F.col("epochs") + F.when(extra, 1).otherwise(0)).where("copies > 0")
    found = found.select(*[f"c{i}" for i in range(len(names))], "n_tokens", "weight", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))
    wanted = {k.lower() for k in keep}
    return given_back(found, names, ["n_tokens", "weight", "epoch"]).select(*[n for n in names if n.lower() in wanted and n.lower() not in ("n_tokens", "weight", "epoch")], "n_tokens", "weight", "epoch")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs, keep=["doc_id", "source"])


ORACLE_SQL = f"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '\\S+')) n, md5(coalesce(text, '')) tx, coalesce(doc_id::varchar, '') id,
    ('0x' || substr(md5('{SEED}:b:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint % {BLOCKS} b, ('0x' || substr(md5('{SEED}:d:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint d
  from documents),
e as (select *, ('0x' || substr(md5('{SEED}:p:' || coalesce(source, '') || ':' || b), 1, 8))::bigint p from d),
s as (select source, sum(n)::bigint t from e group by source),
l as (select list(t::double / (select sum(t) from s) order by source) x, sum(t)::bigint total, count(*) filter (t > 0) n_some from s),
r(k, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select k + 1, case when ok then mid else lo end, case when ok then hi else mid end from (
    select k, lo, hi, (lo + hi) / 2 mid,
      -list_sum(list_transform(y, lambda v: case when v > 0 then v / list_sum(y) * ln(v / list_sum(y)) else 0 end)) >= {ENTROPY_SHARE} * ln(n_some) ok
    from (select *, list_transform(x, lambda v: case when v > 0 then v ** ((lo + hi) / 2) else 0 end) y from r, l where k < {STEPS}))),
a as (select case when -list_sum(list_transform(x, lambda v: case when v > 0 then v * ln(v) else 0 end)) >= {ENTROPY_SHARE} * ln(n_some) or n_some < 2 then 1.0::double else lo end alpha from r, l where k = {STEPS}),
w as (select source, t, (t::double / total) ** alpha / sum((t::double / total) ** alpha) over () weight, total from s, l, a),
q as (select source, weight, floor(weight * total + 0.5)::bigint // t epochs, floor(weight * total + 0.5)::bigint % t rest from w),
c as (select e.*, weight, epochs, rest, sum(n) over (partition by source order by p, b, d, id, tx) upto from e join q using (source)),
m as (select source, min((p, b)) filter (bt > rest) last from (select source, p, b, rest, max(upto) bt from c group by source, p, b, rest) group by source),
k as (select c.*, epochs + case when upto <= rest and (p, b) <= last then 1 else 0 end copies from c join m using (source))
select doc_id, source, n::bigint n_tokens, weight, unnest(range(1, copies + 1)) epoch from k where copies > 0
"""
