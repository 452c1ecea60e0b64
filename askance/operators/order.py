"""Positions, batches, slices and seeded orders over whole tables."""

from __future__ import annotations

from math import ceil, floor

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

_ROWS_PER_BUCKET = 250_000
_LEAST_BUCKETS = 8


def sample_batch_size(batch_size: int) -> int:
    """Ten samples per question: a tenth of the batch, at least two."""
    return max(2, floor(batch_size / fixed.SAMPLES_PER_QUESTION))


def with_position(df: DataFrame, key: str, rows_per_bucket: int = _ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """Add ``pos``, the 0-based rank of the unique numeric ``key``, and return the row count too.

    A global ``row_number`` would sort the table in one task. Here approximate quantiles cut the
    keys into ranges of even size, each range is ranked on its own, and the ranges before it add
    their counts. Every size of table goes this way. What the driver holds is the list of range
    ends: one number per ``rows_per_bucket`` rows, and ``_LEAST_BUCKETS`` of them at least.
    """
    n = df.select(key).count()
    buckets = max(_LEAST_BUCKETS, ceil(n / rows_per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    # An empty table has no quantiles; any end does for it.
    ends = df.agg(F.percentile_approx(F.col(key), shares, 10 * buckets).alias("e")).first()["e"] or [0]
    splits = [-float("inf"), *sorted({float(e) for e in ends}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_k", outputCol="_b")
    binned = cut.transform(df.withColumn("_k", F.col(key).cast("double"))).withColumn("_b", F.col("_b").cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("_b").agg(F.count("*").alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    ranked = binned.join(F.broadcast(starts), "_b").withColumn("pos", (F.col("_start") + inside).cast("bigint"))
    return ranked.drop("_k", "_b", "_start"), n


def with_batches(df: DataFrame, key: str, batch_size: int, **kw) -> DataFrame:
    """Add ``batch_id``: ceil(n / batch_size) near-even runs of rows, the first ones a row longer."""
    placed, n = with_position(df, key, **kw)
    parts = max(1, ceil(n / batch_size))
    small, longer = divmod(n, parts)
    pos, edge = F.col("pos"), longer * (small + 1)
    batch = F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(
        longer + F.floor((pos - edge) / max(small, 1))
    )
    return placed.withColumn("batch_id", batch.cast("int")).drop("pos")


def with_slices(df: DataFrame, key: str, slices: int = fixed.PREDICTION_SLICES, **kw) -> DataFrame:
    """Add ``slice``: consecutive runs of ceil(n / slices) rows."""
    placed, n = with_position(df, key, **kw)
    size = max(1, ceil(n / slices))
    return placed.withColumn("slice", F.floor(F.col("pos") / size).cast("int")).drop("pos")


def seeded_rank(key: Column, seed: int) -> Column:
    """A fixed pseudo-random sort key: the same on any partitioning and after any retry."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, key: str, n: int = fixed.EVAL_SAMPLE, seed: int = fixed.EVAL_SEED) -> DataFrame:
    """The first n rows of the seeded order: a distributed top-n, not a full sort."""
    return df.orderBy(seeded_rank(F.col(key), seed), key).limit(n)


def seeded_shuffle(df: DataFrame, key: str, seed: int = fixed.EVAL_SEED) -> DataFrame:
    rank = seeded_rank(F.col(key), seed)
    return df.withColumn("shuffle_key", rank).orderBy("shuffle_key", key)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top n per group; each task keeps its own top n before the rows move."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
