"""Answers from passages: context within a budget, extractive answers, labels and previews of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions.text import clip, strip, token_count

# Fixed value: how an extractive answer begins.
EXTRACT_HEAD = "The answer model is temporarily unavailable, so here are the most relevant passages from your documents, highest match first:"


def label(title: Column, section: Column, page: Column, document: Column) -> Column:
    name = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.substring(document.cast("string"), 1, 8))
    return F.concat_ws(" > ", name, F.when(F.coalesce(section, F.lit("")) != "", section), F.when(page > 0, F.concat(F.lit("p."), page.cast("string"))))


def context(passages: DataFrame, budget: int = SETTINGS.context_tokens) -> DataFrame:
    """The passages (query_id, rank, text) that fit the budget in order of rank, with used (tokens so far).

    The first is always kept; sums only grow, so what fits is a prefix.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    cost = token_count(strip(F.col("text"))) + SETTINGS.passage_overhead
    found = passages.withColumn("used", F.sum(cost).over(w)).withColumn("_n", F.row_number().over(w))
    return found.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def extractive(passages: DataFrame) -> DataFrame:
    """(query_id, answer) from passages (query_id, rank, label, text, score): the best ones quoted."""
    first = passages.where(F.col("rank") <= SETTINGS.extractive_passages)
    said = F.concat(F.lit("**[S"), F.col("rank").cast("string"), F.lit("] "), F.col("label"), F.lit("** (match "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%)\n> "), clip(F.col("text"), SETTINGS.snippet_chars))
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))).alias("s"))
    return listed.select("query_id", F.concat(F.lit(EXTRACT_HEAD + "\n\n"), F.array_join(F.col("s.said"), "\n\n")).alias("answer"))
