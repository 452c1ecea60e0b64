"""Sinks and stage stores: Parquet under caller-named folders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def model_key(model: Column) -> Column:
    return F.translate(model, "/.", "__")


def run_key(model: Column, method: str) -> Column:
    """File-safe run name: slashes and dots to underscores, method ending added."""
    return F.concat(model_key(model), F.lit(fixed.METHOD_SUFFIX[method]))


def write_runs(runs: DataFrame, path: str) -> None:
    """Run records, one folder per method and model."""
    (
        runs.withColumn("model_key", model_key(F.coalesce("pretrained_model_name", F.lit("unnamed"))))
        .write.mode("overwrite")
        .partitionBy("method", "model_key")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("model_key")


def stage_path(root: str, stage: str, **config) -> str:
    """A folder per stage and full run configuration, so no run reads another's stage."""
    digest = hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    return f"{root}/{stage}/{digest}"


def _has_data(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def materialize(spark: SparkSession, make: Callable[[], DataFrame], path: str, use_cache: bool) -> DataFrame:
    """The stored stage when asked for and complete, else computed, stored and read back."""
    if not (use_cache and _has_data(spark, path)):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_slices(sliced: DataFrame, path: str) -> None:
    """One folder per slice number; reading the parent folder puts the slices together."""
    sliced.write.mode("overwrite").partitionBy("slice").parquet(path)


def metric_rows(df: DataFrame, suite: str, prefix: str, columns: list[str], run: str = "run_id") -> DataFrame:
    """Wide metrics to long rows, keys prefixed by suite."""
    pairs = ", ".join(f"'{prefix}{c}', cast({c} as double)" for c in columns)
    return df.select(
        F.col(run).cast("string").alias("run_id"),
        F.lit(suite).alias("suite"),
        F.expr(f"stack({len(columns)}, {pairs}) as (metric, value)"),
    ).select(
        "run_id", "suite", "metric", F.lit(None).cast("bigint").alias("idx"), "value",
        F.lit(None).cast("string").alias("text"),
    )


def indexed_metric(df: DataFrame, suite: str, metric: str, idx: str, value: str | None, text: str | None) -> DataFrame:
    """Per-row metrics (``{idx: value}`` logs) as long rows."""
    return df.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.lit(suite).alias("suite"),
        F.lit(metric).alias("metric"),
        F.col(idx).cast("bigint").alias("idx"),
        (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"),
        (F.col(text) if text else F.lit(None).cast("string")).alias("text"),
    )


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("suite").parquet(path)
