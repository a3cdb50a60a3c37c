"""Calls to models: providers with offline defaults, resilient batches, breaker states, errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.config import SETTINGS
from quarry.functions.text import found_json, strip
from quarry.functions.text import intent as intent_of
from quarry.functions.vectors import hashed
from quarry.operators import models

ROLES = ("query", "passage", "similarity")
Encode = Callable[[list[str], str], list[list[float]]]


def encode_all(encode: Encode, texts: list[str], role: str, size: int) -> list[list[float]]:
    """Vectors of a batch; a failing batch is halved until the text that fails is alone, which gets zeros."""
    if not texts:
        return []
    try:
        return encode(texts, role)
    except Exception:
        if len(texts) == 1:
            return [[0.0] * size]
        half = len(texts) // 2
        return encode_all(encode, texts[:half], role, size) + encode_all(encode, texts[half:], role, size)


def embed(rows: DataFrame, text: str = "text", role: str = "passage", encode: Encode | None = None, size: int = SETTINGS.dimension) -> DataFrame:
    """rows with embedding. Each different text is encoded once; without a provider, hashed tokens are used."""
    role = role if role in ROLES else "passage"
    if encode is None:
        return rows.withColumn("embedding", hashed(F.col(text), role))
    different = rows.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull()).distinct()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["_t"].tolist()
            made = [v for i in range(0, len(texts), SETTINGS.batch) for v in encode_all(encode, texts[i : i + SETTINGS.batch], role, size)]
            yield pd.DataFrame({"_t": texts, "embedding": made})

    known = different.mapInPandas(each, "_t string, embedding array<double>")
    return rows.join(known, rows[text] == known["_t"], "left").drop("_t")


def stored_key(text: Column, role: str, made_with: str) -> Column:
    """What a stored vector is known by: the text, its role and the model."""
    return F.sha1(F.concat_ws("|", F.lit(made_with), F.lit(role), text))


def embed_stored(rows: DataFrame, path: str, made_with: str, text: str = "text", role: str = "passage", encode: Encode | None = None, size: int = SETTINGS.dimension) -> DataFrame:
    """embed() with a store of vectors that lasts: only texts that it lacks are encoded, once each, and appended to it."""
    spark = rows.sparkSession
    role = role if role in ROLES else "passage"
    schema = "key string, embedding array<double>"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    keyed = rows.withColumn("key", F.when(F.col(text).isNotNull(), stored_key(F.col(text), role, made_with)))
    asked = keyed.where("key is not null").select("key", F.col(text).alias("_text")).dropDuplicates(["key"])
    missing = asked.join(spark.read.schema(schema).parquet(path).select("key"), "key", "left_anti")
    embed(missing, "_text", role, encode, size).select("key", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).dropDuplicates(["key"])
    return keyed.join(known, "key", "left").drop("key")


def breaker(calls: DataFrame, key: str, order: str, failed: str, seconds: str, threshold: int = SETTINGS.breaker_threshold, cooldown: float = SETTINGS.breaker_cooldown) -> DataFrame:
    """(key, calls, rejected, opened, state): an ordered fold of a call log through closed, open and half-open.

    A key's calls are read as a sorted stream with a few numbers of state, so a log of any length needs no more memory.
    """
    rows = calls.select(key, F.col(order).alias("o"), F.col(seconds).cast("double").alias("t"), F.col(failed).cast("boolean").alias("f")).repartition(F.col(key)).sortWithinPartitions(key, "o", "t")
    schema = f"{key} {dict(rows.dtypes)[key]}, calls int, rejected int, opened int, state string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: models.Breaker | None = None
        at, counts, clock = None, [0, 0, 0], [0.0]

        def told() -> None:
            if now is not None:
                done.append((at, *counts, "closed" if now.failures < threshold else "open"))

        for batch in batches:
            for k, t, f in zip(*(batch.column(n).to_pylist() for n in (key, "t", "f")), strict=True):
                if now is None or k != at:
                    told()
                    now, at, counts = models.Breaker(threshold, cooldown, lambda: clock[0]), k, [0, 0, 0]
                clock[0] = t
                counts[0] += 1
                if now.state == "open":
                    counts[1] += 1
                    continue
                now.told(not f)
                counts[2] += now.state == "open"
        told()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch_kind), *(pa.array(c, pa.int32()) for c in columns[1:4]), pa.array(columns[4], pa.string())], names=[key, "calls", "rejected", "opened", "state"])

    batch_kind = to_arrow_type(rows.schema[key].dataType)
    return rows.mapInArrow(fold, schema)


def transient(error: Column, status: Column | None = None) -> Column:
    """Whether a call that failed with this message (and status) is worth another try."""
    by_word = F.exists(F.array(*[F.lit(w) for w in models.AGAIN_WORDS]), lambda w: F.contains(F.lower(error), w))
    return by_word if status is None else F.coalesce(status.isin(*models.AGAIN_STATUS), F.lit(False)) | by_word


def fatal(error: Column, status: Column | None = None) -> Column:
    """Whether the same model is useless after this error."""
    said = F.lower(error)
    by_word = F.contains(said, F.lit("does not exist")) | F.contains(said, F.lit("decommissioned")) | (F.contains(said, F.lit("context")) & F.contains(said, F.lit("length")))
    return by_word if status is None else F.coalesce(status.isin(*models.FATAL_STATUS), F.lit(False)) | by_word


def retry_after(error: Column, headers: Column | None = None) -> Column:
    """Seconds that a server asks to wait, by its headers (a map) or else by its message: 'try again in 3.66s', '450ms'; null without one."""
    number = F.regexp_extract(error, r"(?i)try again in ([\d.]+)\s*(ms|s)\b", 1).try_cast("double")
    said = F.when(F.regexp_extract(error, r"(?i)try again in ([\d.]+)\s*(ms|s)\b", 2).ilike("ms"), number / 1000).otherwise(number)
    if headers is None:
        return said
    value = lambda key: F.rtrim(F.try_element_at(headers, F.lit(key)), F.lit("smh")).try_cast("double") / (1000 if key.endswith("-ms") else 1)
    return F.coalesce(*[value(key) for key in models.WAIT_HEADERS], said)


# --- replies of models ----------------------------------------------------------------------------------------------


def _entries(reply: Column, name: str) -> Column:
    """The entries of a list in the JSON object of a reply; empty if there is none."""
    v = F.try_parse_json(found_json(reply))
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def listwise_scores(reply: Column, candidates: Column) -> Column:
    """Map from candidate (from 1) to score (0 to 1) of a reply {"scores": [{"id": 1, "score": 7}, ...]}."""
    pair = F.transform(_entries(reply, "scores"), lambda e: F.struct(F.try_variant_get(e, "$.id", "int").alias("id"), F.try_variant_get(e, "$.score", "double").alias("s")))
    good = F.filter(pair, lambda p: p["id"].between(1, candidates) & p["s"].isNotNull())
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda x: x["id"] == p["id"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["id"], F.least(F.greatest(p["s"], F.lit(0.0)), F.lit(10.0)) / 10)))


def claim_verdicts(reply: Column) -> Column:
    """Array of (id, verdict) of a reply {"verdicts": [{"id": 1, "verdict": "partial"}, ...]}; unknown verdicts are left out."""
    pair = F.transform(_entries(reply, "verdicts"), lambda e: F.struct(F.try_variant_get(e, "$.id", "int").alias("id"), F.lower(F.trim(F.try_variant_get(e, "$.verdict", "string"))).alias("verdict")))
    return F.filter(pair, lambda p: p["id"].isNotNull() & p["verdict"].isin("supported", "partial", "unsupported"))


# What a question may want.
INTENTS = ("chitchat", "document_qa", "summarize", "compare", "meta")
SOCIAL = ("chitchat", "meta")
PLAN = "struct<intent:string,standalone:string,queries:array<string>,needs_retrieval:boolean,hyde:string,planner:string>"


def _plan(planner: str, intent: Column, question: Column, **parts: Column) -> Column:
    given = {"standalone": question, "queries": F.array(question), "needs_retrieval": ~intent.isin(*SOCIAL), "hyde": F.lit("")} | parts
    return F.struct(intent.alias("intent"), *[v.alias(k) for k, v in given.items()], F.lit(planner).alias("planner")).cast(PLAN)


def planned(question: Column, reply: Column) -> Column:
    """The plan in a model's reply, or the plan without a model where there is none."""
    v = F.try_parse_json(found_json(reply))
    part = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    said = {n: strip(F.coalesce(part(n), F.lit(""))) for n in ("intent", "standalone_question", "hypothetical_answer")}
    intent = F.when(F.lower(said["intent"]).isin(*INTENTS), F.lower(said["intent"])).otherwise("document_qa")
    social = intent.isin(*SOCIAL)
    alone = F.coalesce(F.nullif(said["standalone_question"], F.lit("")), question)
    asked = F.slice(F.filter(F.transform(_entries(reply, "search_queries"), lambda e: strip(F.try_variant_get(e, "$", "string"))), lambda s: F.coalesce(s, F.lit("")) != ""), 1, SETTINGS.max_sub_queries)
    flag = F.when(F.schema_of_variant(part("needs_retrieval", "variant")) == "BOOLEAN", part("needs_retrieval", "boolean"))
    by_model = _plan(
        "llm", intent, question, standalone=alone, queries=F.when(F.size(asked) > 0, asked).otherwise(F.array(alone)), needs_retrieval=~social & F.coalesce(flag, F.lit(True)),
        hyde=F.when(social, F.lit("")).otherwise(F.substring(said["hypothetical_answer"], 1, SETTINGS.hyde_chars)),
    )
    return F.when(v.isNull() | (F.to_json(v) == "{}"), _plan("fallback", F.lit("document_qa"), question)).otherwise(by_model)


def plan_query(question: Column, reply: Column | None = None) -> Column:
    """The plan of a question: by patterns where it needs no search, else by the model's reply (null: none came); without replies by the question alone."""
    q = strip(F.coalesce(question, F.lit("")))
    quick = intent_of(q)
    rest = _plan("heuristic", F.lit("document_qa"), q) if reply is None else planned(q, F.coalesce(reply, F.lit("")))
    return F.when(quick != "document_qa", _plan("heuristic", quick, q)).otherwise(rest)
