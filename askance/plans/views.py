"""Scored questions over the conversation table: the shared start of the scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..sources import tables as t


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return t.qa_pairs(spark, folder, spread_out=True).withColumn("pool_id", F.col("conv_id"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """The other answers of a conversation are a passage's samples."""
    return t.spread(t.answers(spark, folder), "conv_id", "turn").select(F.col("conv_id").alias("pool_id"), "text")


def sentence_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.sentence_scores(passages(spark, folder), samples(spark, folder), passage_in_pool=True)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(q_id, conv_id, turn, prompt, passage, n_sentences, average_score, hallucinated, part_ord)."""
    rows = passages(spark, folder)
    scores = sentence_scores(spark, folder)
    return scoring.split(scoring.passage_scores(rows, scores, "conv_id", "turn", "prompt", "passage"))
