"""Question planning: routing, references to earlier turns, the queries to search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions import text as t


def plan(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions with intent, needs_retrieval, needs_history: the plan without a model."""
    q = F.col(question)
    return questions.withColumn("intent", t.intent(q)).withColumn("needs_retrieval", F.col("intent") == "document_qa").withColumn("needs_history", t.needs_history(q))


def resolved(original: Column, standalone: Column, planner: Column) -> Column:
    """The question to answer: a model's rewrite only where the question refers back."""
    return F.when(F.coalesce(standalone, F.lit("")) == "", original).when(planner != "llm", standalone).when(t.needs_history(original), standalone).otherwise(original)


def extra_queries(original: Column, standalone: Column, searches: Column, resolved_: Column, hyde: Column | None = None) -> Column:
    """What to search besides the resolved question, without repetition in any case, at most five."""
    key = lambda c: F.lower(t.strip(c))
    own = F.filter(F.array(t.strip(original), t.strip(standalone)), lambda s: (s != "") & t.has_content(s))
    every = F.filter(F.concat(own, searches), lambda s: (key(s) != "") & (key(s) != key(resolved_)))
    kept = F.aggregate(every, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda x: key(x) == key(s)), acc).otherwise(F.concat(acc, F.array(s))))
    if hyde is not None:
        kept = F.when(F.coalesce(hyde, F.lit("")) != "", F.concat(kept, F.array(F.substring(hyde, 1, SETTINGS.hyde_chars)))).otherwise(kept)
    return F.slice(kept, 1, SETTINGS.max_sub_queries + 2)


def history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, history): the last turns that have text, a line each, at most 400 characters."""
    w = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    last = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SETTINGS.history_turns)
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.substring(t.squeeze(F.col("text")), 1, 400))
    said = last.where(t.squeeze(F.coalesce("text", F.lit(""))) != "").groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(turn, line.alias("line")))).alias("s"))
    return said.select(conversation, F.array_join(F.col("s.line"), "\n").alias("history"))
