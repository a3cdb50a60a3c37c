"""Verification of answers: claims against their passages, confidence, abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions import text as t
from quarry.functions.vectors import cosine, hashed

ABSTAINED = "The uploaded documents don't verify an answer to this."


def check_claims(answers: DataFrame) -> DataFrame:
    """A row a claim: answer_id, claim_idx, claim, citations, semantic, lexical, support, verdict, uncited.

    answers: answer_id, answer, passages (array of strings). A claim is held against the passages it cites, or all.
    """
    rows = answers.select("answer_id", "passages", F.posexplode(t.claims(F.col("answer"))).alias("claim_idx", "claim"))
    cited = F.filter(t.citations(F.col("claim")), lambda n: (n >= 1) & (n <= F.size("passages")))
    rows = rows.withColumn("citations", cited)
    own = F.when(F.size("citations") > 0, F.transform("citations", lambda n: F.element_at(F.col("passages"), n))).otherwise(F.col("passages"))
    rows = rows.withColumn("evidence", F.array_join(own, "\n")).withColumn("_v", hashed(t.uncited(F.col("claim"))))
    held = rows.select("answer_id", "claim_idx", "_v", F.explode(F.concat(F.col("passages"), F.array("evidence"))).alias("p"))
    near = held.withColumn("s", cosine(F.col("_v"), hashed(F.col("p")))).groupBy("answer_id", "claim_idx").agg(F.max("s").alias("semantic"))
    rows = rows.join(near, ["answer_id", "claim_idx"]).withColumn("lexical", t.lexical_support(F.col("claim"), F.col("evidence")))
    return judged(rows).drop("_v", "passages", "evidence")


def judged(rows: DataFrame) -> DataFrame:
    """Adds support, verdict and uncited to rows with semantic, lexical and citations."""
    raw = SETTINGS.semantic_weight * F.col("semantic") + (1 - SETTINGS.semantic_weight) * F.col("lexical")
    alone = F.size("citations") == 0
    rows = rows.withColumn("_raw", F.round(raw, 9)).withColumn("uncited", alone)
    verdict = F.when(F.col("_raw") >= SETTINGS.min_support + SETTINGS.supported_margin, F.when(alone, "partial").otherwise("supported")).when(F.col("_raw") >= SETTINGS.min_support, "partial").otherwise("unsupported")
    return rows.withColumn("verdict", verdict).withColumn("support", F.round(F.when(alone, F.col("_raw") * SETTINGS.uncited_factor).otherwise(F.col("_raw")), 3)).drop("_raw")


def second_opinion(checked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (answer_id, claim_idx, verdict) of a model on claims that aren't supported; support only rises."""
    v = verdicts.select("answer_id", "claim_idx", F.col("verdict").alias("_v"))
    level = F.when(F.col("_v") == "supported", 0.85).when(F.col("_v") == "partial", 0.55).when(F.col("_v") == "unsupported", 0.1)
    asked = (F.col("verdict") != "supported") & F.col("_v").isNotNull()
    out = checked.join(v, ["answer_id", "claim_idx"], "left")
    return out.withColumn("support", F.when(asked, F.greatest("support", level)).otherwise(F.col("support"))).withColumn("verdict", F.when(asked, F.col("_v")).otherwise(F.col("verdict"))).drop("_v")


def confidence(checked: DataFrame) -> DataFrame:
    """(answer_id, claims, uncited_claims, support_ratio, mean_support, confidence, verified) from checked claims."""
    solid = F.sum(F.when(F.col("verdict") == "supported", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0))
    by = checked.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if("uncited").alias("uncited_claims"), (solid / F.count("*")).alias("support_ratio"), F.avg("support").alias("mean_support"), F.max(F.size("citations") > 0).alias("_cited"))
    score = F.round(F.least(F.lit(1.0), 0.5 * F.col("support_ratio") + 0.35 * F.col("mean_support") + 0.15 * F.when(F.col("_cited"), 1.0).otherwise(0.55)), 3)
    by = by.withColumn("confidence", score).drop("_cited")
    return by.withColumn("verified", (F.col("support_ratio") >= 0.5) & (F.col("confidence") >= SETTINGS.abstain_below))


def ground(answers: DataFrame) -> DataFrame:
    """answers with the final answer, confidence, verified, abstained, method and invalid citations.

    Refusals stay; marks beyond the passages are removed and lower the confidence; weak answers are withheld.
    """
    n = F.size("passages")
    a = answers.withColumn("answer", t.normal_citations(F.col("answer")))
    a = a.withColumn("refusal", t.refusal(F.col("answer"))).withColumn("invalid", t.invalid_citations(F.col("answer"), n)).withColumn("answer", F.when(F.col("refusal"), F.col("answer")).otherwise(t.strip_invalid(F.col("answer"), n)))
    found = confidence(check_claims(a.where(~F.col("refusal") & (n > 0))))
    a = a.join(found, "answer_id", "left")
    empty = (F.coalesce("answer", F.lit("")) == "") | (n == 0)
    base = F.when(F.col("refusal"), 0.5).when(empty, 0.0).otherwise(F.coalesce("confidence", F.lit(0.6)))
    penalty = F.when(F.col("refusal"), 0.0).otherwise(0.1 * F.size("invalid"))
    a = a.withColumn("verified", F.when(F.col("refusal"), True).when(empty, False).otherwise(F.coalesce("verified", F.lit(True))))
    a = a.withColumn("method", F.when(F.col("refusal"), "refusal").when(F.col("claims").isNull() & ~empty, "trivial").when(empty, "none").otherwise("hybrid-lexical-semantic"))
    a = a.withColumn("confidence", F.round(F.greatest(F.lit(0.0), base - penalty), 3))
    a = a.withColumn("abstained", ~F.col("refusal") & (F.col("confidence") < SETTINGS.abstain_below))
    return a.withColumn("answer", F.when(F.col("abstained"), ABSTAINED).otherwise(F.col("answer")))
