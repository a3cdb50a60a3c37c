"""Retrieval and answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import squeeze

# Phrases by which an answer counts as declined.
REFUSALS = ("not contain", "no information", "could not find", "couldn't find", "does not mention", "not mentioned", "not specified", "no passage", "not provide", "unable to")


def ranking(hits: DataFrame, relevant: DataFrame, questions: DataFrame) -> DataFrame:
    """recall, mrr and precision over questions: hits (query_id, chunk_id, rank), relevant (query_id, chunk_id)."""
    mark = relevant.select("query_id", "chunk_id").distinct().withColumn("_r", F.lit(1))
    per = hits.join(mark, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min(F.when(F.col("_r") == 1, F.col("rank"))).alias("first"), (F.coalesce(F.sum("_r"), F.lit(0)) / F.count("*")).alias("p"))
    per = questions.select("query_id").distinct().join(per, "query_id", "left")
    return per.agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce("p", F.lit(0.0))), 6).alias("precision"))


def expected(answer: Column, needles: Column, every: bool = False) -> Column:
    """Whether an answer has one (or every one) of the expected strings, in any case and spacing."""
    said = F.lower(squeeze(answer))
    held = lambda n: F.contains(said, F.lower(squeeze(n)))
    return F.forall(needles, held) if every else F.exists(needles, held)


def declined(answer: Column) -> Column:
    said = F.lower(answer)
    return F.exists(F.array(*[F.lit(p) for p in REFUSALS]), lambda p: F.contains(said, p))


def nearest_rank(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50 and p95 by nearest rank, from counts of equal values, so no group is gathered as a whole."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum("_c").over(Window.partitionBy(*by))
    at = counts.withColumn("_u", F.sum("_c").over(w)).withColumn("_n", total)
    p50 = F.min(F.when(F.col("_u") > F.floor(F.col("_n") / 2), F.col(value)))
    p95 = F.min(F.when(F.col("_u") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95)), F.col(value)))
    return at.groupBy(*by).agg(F.max("_n").alias("n"), p50.alias("p50"), p95.alias("p95"))


def outcomes(questions: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a question: query_id, answerable, rank (of the first relevant source), precision, correct, grounded, declined, outcome.

    questions: query_id, answerable, expects and relevant (arrays); answers: query_id, answer, confidence, grounded, abstained;
    sources: query_id, rank, section. A source is relevant if its section holds one of the relevant strings, in any case. An
    unanswerable question is well served by abstaining, or by one word that is unsure or reads as a refusal.
    """
    want = F.transform("relevant", lambda r: F.lower(r))
    met = sources.join(questions.select("query_id", want.alias("_want")), "query_id")
    hit = F.exists("_want", lambda w: F.contains(F.lower(F.coalesce(F.col("section"), F.lit(""))), w))
    per = met.withColumn("_hit", hit).groupBy("query_id").agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("rank"), (F.count_if("_hit") / F.count("*")).alias("precision"))
    rows = questions.join(answers, "query_id").join(per, "query_id", "left")
    correct = (F.size("expects") > 0) & expected(F.col("answer"), F.col("expects"))
    unsure = (F.col("confidence") < 0.5) | declined(F.col("answer"))
    gave_up = F.col("abstained") | (~F.contains(squeeze(F.col("answer")), F.lit(" ")) & unsure)
    outcome = F.when(F.col("answerable"), F.when(correct, "ok").otherwise("MISS")).otherwise(F.when(gave_up, "declined").otherwise("HALLUCINATED"))
    return rows.select("query_id", "answerable", "rank", F.coalesce("precision", F.lit(0.0)).alias("precision"), correct.alias("correct"), "grounded", gave_up.alias("declined"), outcome.alias("outcome"))


def summary(rows: DataFrame) -> DataFrame:
    """One row over outcomes(): questions, recall, mrr, precision, answer_accuracy, groundedness and correct_abstention, shares of the
    answerable and of the other questions."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    share = lambda of, what: F.round(F.coalesce(F.sum(F.when(of, what)), F.lit(0.0)) / F.greatest(F.count_if(of), F.lit(1)), 6)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return rows.agg(
        F.count("*").alias("questions"), share(yes, one(F.col("rank").isNotNull())).alias("recall"), share(yes, F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), share(yes, F.col("precision")).alias("precision"),
        share(yes, one(F.col("correct"))).alias("answer_accuracy"), share(yes, one(F.col("grounded"))).alias("groundedness"), share(no, one(F.col("declined"))).alias("correct_abstention"),
    )
