"""The library of documents: pages of a list, counts by status, upserts, deletions, uploads, states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import SETTINGS


def page(docs: DataFrame, order: list, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """One page of the list; limit 1 to 200."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    for name, value in equal.items():
        docs = docs.where(F.col(name) == value)
    return docs.orderBy(*order).offset(offset).limit(limit)


def counts_by(docs: DataFrame, status: str, known: list[str]) -> DataFrame:
    """(status, n) of all known values, zero where there is none."""
    every = docs.sparkSession.createDataFrame([(k,) for k in known], f"{status} string")
    return every.join(docs.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def upsert(stored: DataFrame, new: DataFrame, key: str, owner: str | None = None) -> DataFrame:
    """stored with new's rows in place of those of the same key or, if owner is given, of the same owner (so that what a
    shorter new version lacks goes too)."""
    on = owner or key
    return stored.join(new.select(on).distinct(), on, "left_anti").unionByName(new)


def get(docs: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; an error if there is none."""
    found = docs.where(F.col(key) == value)
    if not found.take(1):
        raise KeyError(f"no document with {key} {value!r}")
    return found


def delete(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """What each table keeps when documents go: tables by name with the column that holds the document, gone with its key."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(ids, df[own] == ids["_gone"], "left_anti") for name, (df, own) in tables.items()}


def verdicts(files: DataFrame, request: str | None = None) -> DataFrame:
    """files (name, length) with reason: null for a file that may be uploaded. Of a request with too many files none may."""
    kind = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    reason = F.when(~kind.isin("pdf", "docx", "txt", "md", "markdown"), "unsupported").when(F.col("length") == 0, "empty").when(F.col("length") > SETTINGS.max_bytes, "too large")
    if request is not None:
        crowded = files.groupBy(request).agg(F.count("*").alias("_files"))
        files = files.join(crowded, request)
        reason = F.when(F.col("_files") > SETTINGS.max_files, "too many files").otherwise(reason)
    return files.withColumn("reason", reason).drop("_files")


def pending(files: DataFrame, key: str = "path") -> DataFrame:
    """The rows that accepted files (name, length, reason and a key) add to the documents: id, filename, file_type, file_size, status, stage."""
    kind = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    return files.where("reason is null").select(F.md5(F.col(key).cast("string")).alias("id"), F.substring("name", 1, 255).alias("filename"), kind.alias("file_type"), F.col("length").cast("long").alias("file_size"), F.lit("pending").alias("status"), F.lit("").alias("stage"))


def ordered(rows: DataFrame, owner: str, order: str, *columns: str, only=None) -> DataFrame:
    """(owner, rows): each owner's rows in order, as an array of structs; only says which owner, if not all. An owner is a
    document, whose chunks are bounded by its length."""
    rows = rows if only is None else rows.where(F.col(owner) == only)
    return rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def latest(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the last state of each key."""
    return events.groupBy(key).agg(F.max_by(value, F.col(order)).alias(value))
