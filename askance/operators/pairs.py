"""Training frames and preference pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


def left_join_skewed(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left outer join that holds up when one key has a large share of the right side.

    Adaptive execution splits a hot key on either side of an inner join, but only on the left
    side of a left outer join; so matched and unmatched rows are made apart. The unmatched side
    needs the right side's distinct keys only, which are thinned before they move.
    """
    matched = left.join(right, on, "inner")
    missing = left.join(right.select(on).distinct(), on, "left_anti")
    return matched.unionByName(missing, allowMissingColumns=True)


def predictions(scored: DataFrame) -> DataFrame:
    """Prompt and passage, cleaned: missing text to the mark, then stripped."""
    return scored.select(tx.clean(F.col("prompt")).alias("prompt"), tx.clean(F.col("passage")).alias("passage"))


def clean_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: tx.strip(F.col(c).cast("string")) for c in columns})


def training_frame(answers: DataFrame, scored: DataFrame, judge: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Answers left-joined with the passages on the prompt, with the judge's text and score."""
    joined = left_join_skewed(answers, predictions(scored), "prompt")
    verdict = judge(F.col("prompt"), F.col("answer_text"), F.coalesce("passage", F.lit(fixed.MISSING_TEXT)))
    return joined.withColumn("similarity_text", verdict).withColumn(
        "similarity", tx.verdict_score(F.col("similarity_text"))
    ).withColumn("is_valid_verdict", F.col("similarity") != fixed.UNKNOWN_VERDICT)


def preference_pairs(train: DataFrame, prompt_format: Callable[[Column], Column], *keep: str) -> DataFrame:
    """Own passage against the mark where the judge agreed, else the answer against the passage."""
    agreed = F.col("similarity") > fixed.AGREEMENT_THRESHOLD
    passage = F.coalesce("passage", F.lit(fixed.MISSING_TEXT))
    return train.select(
        *keep,
        prompt_format(F.col("prompt")).alias("prompt"),
        tx.strip(F.when(agreed, passage).otherwise(F.col("answer_text"))).alias("chosen"),
        tx.strip(F.when(agreed, F.lit(fixed.MISSING_TEXT)).otherwise(passage)).alias("rejected"),
    )
