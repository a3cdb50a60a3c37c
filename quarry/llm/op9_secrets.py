"""Secret scans with corpus-wide ownership frequency.

Base kinds assign, access and hex are found by their patterns, leftmost and without overlap, and always stay. The
method adds spans of further kinds (bearer, jwt, pem, prefixed, mixed) where they look live. Every candidate's value
is hashed; over the whole corpus each hash gets its number of distinct repositories and of distinct owners. A value of more
than max_owners owners, or in more than max_repos repositories, is a widely copied example; one that stays with its
owner, in few repositories, and doesn't read like a placeholder is live. Added spans that are no live credential are dropped
again; base spans are only counted as live or shared. Documents have one column for where they come from, so in the query
the source is the owner and each different text of it a repository: exact copies of a text are one place that holds the value.

Distinct repositories and owners of a value are combined in each task before they meet by hash, and the statistics are written
before they are joined, so a value that a third of all rows hold is a few rows when it is counted and its rows can be split.

Defined cases: a null text is empty and has no span; a null repository or owner counts as one of its own; rows that
repeat an id are scanned and returned each; positions are code points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, table

# The kinds in order, the base patterns and their least lengths.
KINDS = ("assign", "access", "hex", "bearer", "jwt", "pem", "prefixed", "mixed")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# What the method adds.
BEARER = re.compile(r"(?ai:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
PREFIXED = re.compile(r"\b(?:gh[opsu]|xox[abp]|sk_live|sk_test|glpat)[_-][A-Za-z0-9-]{16,}")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{32,}")
PLACEHOLDER = re.compile(r"(?ai:example|changeme|change_me|placeholder|dummy|sample|redacted|your|xxxx|12345678|abcdef|password)")
MIXED_BITS = 4.0
MAX_REPOS = 20  # repositories of one owner that may hold a live value
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as HEX of that length


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if any(len(w) >= LEAST["hex"] for w in text.split()):
        out += [("hex", m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return out


def added_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    out = []
    if "bearer" in text.lower():
        out += [("bearer", m.start(), m.end(), m[1]) for m in BEARER.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end(), m[0]) for m in JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", m.start(), m.end(), text[m.end() : m.end() + 96]) for m in PEM.finditer(text)]
    if "_" in text or "-" in text:
        out += [("prefixed", m.start(), m.end(), m[0]) for m in PREFIXED.finditer(text)]
    if any(len(w) >= 32 for w in text.split()):
        taken = sorted((a, b) for _, a, b, _ in [*base, *out])
        for m in MIXED.finditer(text):
            v = m[0]
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= MIXED_BITS:
                out.append(("mixed", m.start(), m.end(), v))
    return out


SPAN = "struct<start:long,rank:int,stop:long,hash:string,placeholder:boolean>"


def scan(docs: DataFrame, repo_col: str | None, owner_col: str) -> DataFrame:
    """A row of (doc_id, repo, owner, base, added) for each row, spans as arrays of structs; without repo_col each text of an owner is a repository."""
    repo = F.col(repo_col).cast("string") if repo_col else F.xxhash64(F.col(owner_col).cast("string"), F.col("text").cast("string")).cast("string")
    rows = docs.select(F.col("doc_id"), repo.alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    rank = {k: i for i, k in enumerate(KINDS)}
    struct = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("hash", pa.string()), ("placeholder", pa.bool_())])

    def told(spans: list[tuple[str, int, int, str]]) -> list[dict]:
        return [{"start": a, "rank": rank[k], "stop": b, "hash": hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), "placeholder": bool(PLACEHOLDER.search(v)) or len(set(v)) < 5} for k, a, b, v in sorted(spans, key=lambda s: (s[1], rank[s[0]]))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for t in batch.column(3):
                t = t.as_py() or ""
                own = base_spans(t)
                base.append(told(own))
                added.append(told(added_spans(t, own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base, pa.list_(struct)), pa.array(added, pa.list_(struct))], names=["doc_id", "repo", "owner", "base", "added"])

    return arrow_batches(rows).mapInArrow(each, f"doc_id {kind}, repo string, owner string, base array<{SPAN}>, added array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repos, owners, rows) over the whole corpus."""
    values = found.select("repo", "owner", F.explode(F.concat("base", "added")).alias("s")).select(F.col("s.hash").alias("hash"), "repo", "owner")
    each = values.groupBy("hash", "repo", "owner").agg(F.count("*").alias("rows"))
    none = F.lit("\0null")
    return each.groupBy("hash").agg(F.count_distinct(F.coalesce("repo", none)).alias("repos"), F.count_distinct(F.coalesce("owner", none)).alias("owners"), F.sum("rows").alias("rows"))


def find_secrets(docs: DataFrame, repo_col: str | None = None, owner_col: str = "source", max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, base and all spans (arrays of struct start, rank in KINDS, stop), n_live, n_shared of each row."""
    found = cut(scan(docs, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    stats = cut(ownership(found).select("hash", ((F.col("owners") > max_owners) | (F.col("repos") > max_repos)).alias("common")))  # so both sides of the join are shuffled and a common value's rows can be split
    values = found.select("row", F.posexplode(F.concat("base", "added")).alias("i", "s"), F.size("base").alias("n")).select("row", "i", "n", "s", F.col("s.hash").alias("hash"))
    judged = values.join(stats, "hash").withColumn("live", ~F.col("common") & ~F.col("s.placeholder"))
    per = judged.groupBy("row").agg(
        F.count_if("live").alias("n_live"), F.count_if("common").alias("n_shared"),
        F.sort_array(F.collect_list(F.when(F.col("live") & (F.col("i") >= F.col("n")), F.col("s")))).alias("kept"),
    )
    out = found.join(per, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("kept", F.array_except("base", "base")))).alias("spans"), zero(F.col("n_live")).alias("n_live"), zero(F.col("n_shared")).alias("n_shared"))


def _joined(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), "n_live", "n_shared")
