"""Answers assembled: the route of each question, its answer, how sure it is, its sources and what to warn of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import answer, ground

GREETING = "Hi! Upload a PDF, DOCX, markdown or text file and I'll answer questions about it, with citations back to the page."
NOT_FOUND = "I couldn't find anything about that in your documents. Try wording closer to theirs, or upload the file that covers it."
CANNED = "no model available: canned reply"
VERBATIM = "answered without a model: passages returned verbatim"
EXTRACTIVE_CONFIDENCE = 0.35


def route(intent: Column, passages: Column, reply: Column) -> Column:
    """grounded, extractive, chitchat or no_context; reply is a model's answer, null without one."""
    return F.when(intent.isin("chitchat", "meta"), "chitchat").when(F.size(passages) == 0, "no_context").when(reply.isNull(), "extractive").otherwise("grounded")


def small_talk(hint: Column) -> Column:
    """What is said without a model; hint is a line about the library."""
    return F.when(F.coalesce(hint, F.lit("")) == "", F.lit(GREETING)).otherwise(F.concat(F.lit("Hi! "), hint, F.lit(" Ask me anything about them.")))


def gathered(hits: DataFrame) -> DataFrame:
    """(query_id, passages) from hits (query_id, rank, chunk_id, label, text, score): a question's passages, a bounded number, by rank."""
    one = F.struct("rank", "chunk_id", "label", "text", F.col("score").cast("double").alias("score"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("passages"))


def respond(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """A row a question: query_id, intent, mode, answer, confidence, grounded, abstained, degraded, sources, warnings.

    questions: query_id, intent, hint, reply (a model's, null without one); hits as in gathered(). Only replies about passages are
    verified; their sources are marked where the final answer cites them.
    """
    rows = questions.join(gathered(hits), "query_id", "left").withColumn("passages", F.when(F.col("intent").isin("chitchat", "meta") | F.col("passages").isNull(), F.expr("slice(passages, 1, 0)")).otherwise(F.col("passages")))
    rows = rows.withColumn("passages", F.coalesce("passages", F.array().cast(hits.select(F.array(F.struct("rank", "chunk_id", "label", "text", F.col("score").cast("double").alias("score")))).schema[0].dataType)))
    rows = rows.withColumn("mode", route(F.col("intent"), F.col("passages"), F.col("reply")))
    checked = ground.ground(rows.where("mode = 'grounded'").select(F.col("query_id").alias("answer_id"), F.col("reply").alias("answer"), F.col("passages.text").alias("passages")))
    checked = checked.select(F.col("answer_id").alias("query_id"), F.col("answer").alias("_answer"), F.col("confidence").alias("_confidence"), "verified", "abstained", "refusal", F.size("invalid").alias("_invalid"))
    quoted = answer.extractive(rows.where("mode = 'extractive'").select("query_id", F.inline("passages")).select("query_id", "rank", "label", "text", "score")).withColumnRenamed("answer", "_quoted")
    rows = rows.join(checked, "query_id", "left").join(quoted, "query_id", "left")
    mode = F.col("mode")
    said = F.when(mode == "grounded", F.col("_answer")).when(mode == "extractive", F.col("_quoted")).when(F.col("reply").isNotNull(), F.col("reply")).when(mode == "chitchat", small_talk(F.col("hint"))).otherwise(F.lit(NOT_FOUND))
    rows = rows.withColumn("answer", said)
    sure = F.when(mode == "grounded", F.col("_confidence")).when(mode == "extractive", EXTRACTIVE_CONFIDENCE).when(mode == "chitchat", 1.0).otherwise(0.0)
    cited = t.citations(F.when(mode == "grounded", F.col("answer")))
    notes = F.array(
        F.when((mode == "grounded") & F.col("refusal"), "the model found no answer in the passages"),
        F.when((mode == "grounded") & (F.col("_invalid") > 0), F.concat(F.lit("removed "), F.col("_invalid").cast("string"), F.lit(" invented citation(s)"))),
        F.when(F.coalesce("abstained", F.lit(False)), F.lit("too little support: the answer is withheld")),
        F.when(mode.isin("chitchat", "no_context") & F.col("reply").isNull(), CANNED), F.when(mode == "extractive", VERBATIM),
    )
    source = lambda p: F.struct(p["rank"].alias("n"), p["chunk_id"].alias("chunk_id"), p["label"].alias("label"), F.substring(p["text"], 1, 600).alias("preview"), F.round(p["score"], 4).alias("score"), F.array_contains(cited, p["rank"].cast("int")).alias("cited"))
    return rows.select(
        "query_id", "intent", "mode", "answer", F.round(sure, 3).alias("confidence"), F.coalesce("verified", F.lit(False)).alias("grounded"), F.coalesce("abstained", F.lit(False)).alias("abstained"), F.col("reply").isNull().alias("degraded"),
        F.transform("passages", source).alias("sources"), F.array_distinct(F.array_compact(notes)).alias("warnings"),
    )
