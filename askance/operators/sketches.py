"""Distinct questions by mergeable sketches: counted per poll once, merged over any set of polls.

An exact distinct count over some polls needs all their questions again. A sketch of a poll's questions is a few
kilobytes, is made in one grouped pass with partial sketches per task, and the union of sketches is the sketch of the
union; so polls are sketched as they come, stored, and any span of them is counted from the stored sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: log2 of the sketch's registers: 16 KB at most, far less for few questions.
LG_REGISTERS = 14
STORED = "run_id string, poll string, n_questions bigint, sketch binary"


def relative_error(lg_registers: int = LG_REGISTERS, deviations: float = 3.0) -> float:
    """The stated bound: so many standard errors of a merged sketch (1.04 / sqrt(registers))."""
    return deviations * 1.04 / 2 ** (lg_registers / 2)


def sketch_polls(questions: DataFrame, run: Column, poll: Column, text: str = "prompt", lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(run_id, poll, n_questions, sketch) per run and poll. NULL questions are counted and not sketched."""
    return questions.groupBy(run.cast("string").alias("run_id"), poll.cast("string").alias("poll")).agg(
        F.count("*").alias("n_questions"), F.hll_sketch_agg(text, lg_registers).alias("sketch")
    )


def store(sketches: DataFrame, path: str) -> None:
    """One folder per poll; a poll that is sketched again replaces its folder and no other."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("poll").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def _estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch).cast("bigint")


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, n_questions, n_distinct, curiosity): estimates over all sketches of a group, whatever their sizes.

    ``curiosity`` is the share of distinct questions. No more questions are distinct than there are.
    """
    union = sketches.groupBy(*by).agg(F.sum("n_questions").alias("n_questions"), F.hll_union_agg("sketch", F.lit(True)).alias("_s"))
    return _counted(union, "_s", "n_questions", *by)


def so_far(sketches: DataFrame) -> DataFrame:
    """(run_id, poll, n_questions, n_distinct, curiosity): over the polls of a run up to and with each.

    The window sees one sketch per poll, however many questions a poll had.
    """
    up_to = Window.partitionBy("run_id").orderBy("poll").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sketches.select(
        "run_id", "poll", F.sum("n_questions").over(up_to).alias("n_questions"), F.hll_union_agg("sketch", F.lit(True)).over(up_to).alias("_s")
    )
    return _counted(rows, "_s", "n_questions", "run_id", "poll")


def _counted(rows: DataFrame, sketch: str, n: str, *keep: str) -> DataFrame:
    counted = rows.withColumn("n_distinct", F.least(_estimate(F.col(sketch)), F.col(n)))
    share = F.try_divide(F.col("n_distinct").cast("double"), F.col(n).cast("double"))
    return counted.select(*keep, n, "n_distinct", share.alias("curiosity"))
