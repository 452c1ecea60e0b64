"""Routing questions to a model variant by a learned class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v
from .order import seeded_rank


def router_rows(scored: DataFrame, prompt_format: Callable[[Column], Column], seed: int) -> DataFrame:
    """(q_id, prompt, label, shuffle_key): sound questions 0, doubtful ones 1, seeded order key."""
    return scored.select(
        "q_id",
        prompt_format(F.col("prompt")).alias("prompt"),
        F.when(tx.hallucinated(F.col("average_score")), 1).otherwise(0).alias("label"),
        seeded_rank(F.col("q_id"), seed).alias("shuffle_key"),
    )


def class_count(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.agg(F.count_distinct(label).alias("n_classes"))


def mean_pool(vectors: DataFrame, group: list[str], vector: str) -> DataFrame:
    """(group, features): the mean vector, summed per coordinate across tasks."""
    return (
        vectors.select(*group, F.posexplode(vector).alias("j", "x"))
        .groupBy(*group, "j")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(*group)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("features"))
    )


def text_features(rows: DataFrame, text: str, embed: Callable[[Column], Column], dims: int) -> DataFrame:
    """``rows`` with ``n_parts`` and ``features``, the mean vector of the text's sentences, for texts that have one.

    A text's vectors stay in its own row, so pooling moves nothing.
    """
    parts = rows.withColumn("_parts", tx.sentences(F.col(text))).filter(F.size("_parts") > 0)
    pooled = v.mean_vector(F.transform("_parts", embed), dims)
    return parts.withColumn("n_parts", F.size("_parts").cast("bigint")).withColumn("features", pooled).drop("_parts")


def fit_router(rows: DataFrame, vector: str, label: str = "label") -> LogisticRegressionModel:
    """Class from pooled vector; sums are reduced across tasks, rows stay where they are."""
    ready = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=30, regParam=1e-3, family="multinomial").fit(ready)


def held_out(key: Column, seed: int, one_in: int = 5) -> Column:
    """True for about one key in ``one_in``: the same keys on any partitioning and in any run."""
    return F.conv(F.substring(seeded_rank(key, seed), 1, 8), 16, 10).cast("bigint") % one_in == 0


def save_router(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_router(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def accuracy_rows(rows: DataFrame, vector: str, model: LogisticRegressionModel, seed: int, key: str, label: str = "label") -> DataFrame:
    """(run_id, n, accuracy): the share of right classes among the rows fitted on (``fitted``) and the others (``held_out``)."""
    ready = rows.select(key, label, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    part = F.when(held_out(F.col(key), seed), "held_out").otherwise("fitted").alias("run_id")
    right = (F.col("prediction") == F.col(label)).cast("double")
    return model.transform(ready).groupBy(part).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def route(rows: DataFrame, key: str, vector: str, model: LogisticRegressionModel, variants: list[str]) -> DataFrame:
    """(key, route, variant, is_known_route): the likeliest class and the model variant it stands for.

    Variant 0 is the base model. A class past the list has no variant: NULL, and the flag is false.
    """
    ready = rows.select("*", array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    names = F.array(*[F.lit(v) for v in variants])
    chosen = F.col("prediction").cast("int")
    return model.transform(ready).select(
        *[c for c in rows.columns if c != vector],
        chosen.alias("route"),
        F.get(names, chosen).alias("variant"),
        (chosen < len(variants)).alias("is_known_route"),
    )
