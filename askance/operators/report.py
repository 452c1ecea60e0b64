"""Run measures: curiosity, knowledge-limit awareness, brevity and the combined score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def awareness(hallucinated: Column) -> Column:
    """Share of questions found doubtful; NULL for an empty run."""
    return F.try_divide(F.count_if(hallucinated).cast("double"), F.count("*").cast("double"))


def brevity(text: Column) -> Column:
    """1 within 50 characters of the ideal length on average, 0 from 100 on, linear between."""
    gap = F.avg(F.abs(F.length(text) - fixed.IDEAL_QUESTION_CHARS).cast("double"))
    ideal = float(fixed.IDEAL_QUESTION_CHARS)
    return F.when(gap >= ideal, F.lit(0.0)).when(gap <= ideal / 2, F.lit(1.0)).otherwise(1.5 - gap / ideal)


def brevity_of(gap: Column) -> Column:
    """Brevity from the mean gap to the ideal length."""
    ideal = float(fixed.IDEAL_QUESTION_CHARS)
    return F.when(gap >= ideal, F.lit(0.0)).when(gap <= ideal / 2, F.lit(1.0)).otherwise(1.5 - gap / ideal)


def run_sums(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, run_id, n_questions, n_hallucinated, gap_sum): per run, whole numbers that add up over any set of runs."""
    gap = F.abs(F.length("prompt") - fixed.IDEAL_QUESTION_CHARS).cast("bigint")
    return scored.groupBy(*keys, "run_id").agg(
        F.count("*").alias("n_questions"), F.count_if("hallucinated").alias("n_hallucinated"), F.sum(gap).alias("gap_sum")
    )


def rollup_report(sums: DataFrame, *keys: str) -> DataFrame:
    """Awareness and brevity per combination of ``keys``, with subtotals from the right and the grand total.

    ``sums``: ``run_sums`` or their store, so the questions are not read again. ``level`` says how many of the keys a
    row has: that tells a subtotal from a group whose key is NULL.
    """
    n = F.sum("n_questions").cast("double")
    grouped = sums.rollup(*keys).agg(
        (F.lit(len(keys)) - F.bit_count(F.grouping_id())).cast("int").alias("level"),
        F.count("*").alias("n_runs"), F.sum("n_questions").alias("n_questions"), F.sum("n_hallucinated").alias("n_hallucinated"),
        F.try_divide(F.sum("n_hallucinated").cast("double"), n).alias("knowledge_limit_awareness_score"),
        F.try_divide(F.sum("gap_sum").cast("double"), n).alias("gap"),
    )
    return grouped.withColumn("brevity_coefficient", brevity_of(F.col("gap"))).drop("gap")


def combined(brevity_: Column, curiosity: Column, awareness_: Column) -> Column:
    return brevity_ * ((curiosity + awareness_) / 2)


def question_counts(questions: DataFrame, run: str = "run_id", text: str = "prompt") -> DataFrame:
    """(run, text, copies): the distinct questions of each run."""
    return questions.groupBy(run, text).agg(F.count("*").alias("copies"))


def literal_labels(questions: DataFrame, run: str = "run_id", text: str = "prompt") -> DataFrame:
    """(run, text, copies, label) for runs of at most ten distinct questions: one cluster each.

    The window sees only such runs' distinct questions, so never more than ten rows per run.
    """
    distinct = question_counts(questions, run, text)
    small = (
        distinct.groupBy(run).agg(F.count("*").alias("n")).filter(F.col("n") <= fixed.MAX_LITERAL_CLUSTERS).select(run)
    )
    order = Window.partitionBy(run).orderBy(text)
    return distinct.join(small, run).withColumn("label", (F.row_number().over(order) - 1).cast("int"))


def run_measures(scored: DataFrame, run: str = "run_id", text: str = "prompt") -> DataFrame:
    """One row per run with everything but cluster counts, in a single grouped pass."""
    per_text = scored.groupBy(run, text).agg(
        F.count("*").alias("copies"),
        F.count_if("hallucinated").alias("doubtful"),
        F.abs(F.length(F.col(text)) - fixed.IDEAL_QUESTION_CHARS).cast("double").alias("gap"),
    )
    mean_gap = F.sum(F.col("gap") * F.col("copies")) / F.sum("copies")
    ideal = float(fixed.IDEAL_QUESTION_CHARS)
    return (
        per_text.groupBy(run)
        .agg(
            F.sum("copies").alias("n_questions"),
            F.sum("doubtful").alias("n_hallucinated"),
            F.count("*").alias("n_distinct"),
            mean_gap.alias("gap"),
        )
        .select(
            run,
            "n_questions",
            "n_hallucinated",
            "n_distinct",
            F.try_divide(F.col("n_hallucinated").cast("double"), F.col("n_questions").cast("double")).alias(
                "knowledge_limit_awareness_score"
            ),
            F.when(F.col("gap") >= ideal, F.lit(0.0))
            .when(F.col("gap") <= ideal / 2, F.lit(1.0))
            .otherwise(1.5 - F.col("gap") / ideal)
            .alias("brevity_coefficient"),
        )
    )


def run_report(scored: DataFrame, clusters: DataFrame | None = None, run: str = "run_id", text: str = "prompt") -> DataFrame:
    """All scores per run.

    Runs of at most ten distinct questions count those. Larger ones take ``clusters`` (run,
    num_clusters, num_outliers); without a row there their curiosity stays NULL, and
    ``curiosity_branch`` says which way was taken.
    """
    base = run_measures(scored, run, text)
    literal = F.col("n_distinct") <= fixed.MAX_LITERAL_CLUSTERS
    if clusters is None:
        base = base.withColumn("unique_big", F.lit(None).cast("bigint"))
    else:
        sums = clusters.select(run, (F.col("num_clusters") + F.col("num_outliers")).cast("bigint").alias("unique_big"))
        base = base.join(sums, run, "left")
    unique = F.when(literal, F.col("n_distinct")).otherwise(F.col("unique_big"))
    curiosity = F.try_divide(unique.cast("double"), F.col("n_questions").cast("double"))
    return base.withColumn("curiosity_score", curiosity).select(
        run,
        "n_questions",
        "n_hallucinated",
        F.when(literal, "distinct").otherwise("cluster").alias("curiosity_branch"),
        "curiosity_score",
        "knowledge_limit_awareness_score",
        "brevity_coefficient",
        combined(
            F.col("brevity_coefficient"), F.col("curiosity_score"), F.col("knowledge_limit_awareness_score")
        ).alias("self_learning_capability_score"),
    )
