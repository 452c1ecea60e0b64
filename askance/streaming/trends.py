"""Trending topics as a stream: hourly counts, top topics per hour, runs per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.order import first_per_group
from ..schema import EVENTS
from ..sources.tables import topic_events

WATERMARK = "10 minutes"
POLL = "1 hour"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """Topic events from the files that arrive in a folder."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return topic_events(raw)


def hourly_counts(events: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """(hour, title, n): works on a stream and on a table alike."""
    if watermark and events.isStreaming:
        events = events.withWatermark("ts", watermark)
    return (
        events.groupBy(F.window("ts", POLL), "title")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("hour"), "title", "n")
    )


def top_topics(counts: DataFrame, n: int = fixed.TOPICS_PER_POLL) -> DataFrame:
    """(hour, title, n, rank): the first n titles of each hour, most frequent first."""
    return first_per_group(counts, ["hour"], [F.col("n").desc(), F.col("title")], n)


def poll_topics(counts: DataFrame) -> DataFrame:
    """(run_id, q_id, topics): the polled topics as run rows, one run per hour.

    ``q_id`` is the hour's number since 1970 times the poll size plus the rank: the same after a
    restart.
    """
    hour = F.unix_seconds("hour") / 3600
    return top_topics(counts).select(
        F.date_format("hour", "yyyy-MM-dd HH").alias("run_id"),
        (hour.cast("bigint") * fixed.TOPICS_PER_POLL + F.col("rank") - 1).alias("q_id"),
        F.col("title").alias("topics"),
    )


def run_stream(
    counts: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    once: bool = False,
):
    """Start the poll loop: closed hours reach ``work`` micro-batch by micro-batch.

    Each batch is written under its own number and overwritten when replayed, so a restart from
    the checkpoint neither repeats nor loses an hour. Batches come hourly, or with ``once`` until
    the waiting files are used up.
    """

    def store(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def hourly_sums(scored: DataFrame) -> DataFrame:
    """(run_id, n, n_hallucinated, gap_sum): sums that can be added over any set of hours."""
    gap = F.abs(F.length("prompt") - fixed.IDEAL_QUESTION_CHARS).cast("bigint")
    return scored.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if("hallucinated").alias("n_hallucinated"), F.sum(gap).alias("gap_sum")
    )


def scores_so_far(sums: DataFrame) -> DataFrame:
    """Awareness and mean length gap per hour and over all hours up to it.

    One row per hour reaches the running window, however many topics an hour had.
    """
    so_far = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def share(top, n):
        return F.try_divide(top.cast("double"), n.cast("double"))

    n, hits, gap = F.col("n"), F.col("n_hallucinated"), F.col("gap_sum")
    return sums.select(
        "run_id",
        "n",
        share(hits, n).alias("awareness"),
        share(gap, n).alias("mean_gap"),
        F.sum(n).over(so_far).alias("n_so_far"),
        share(F.sum(hits).over(so_far), F.sum(n).over(so_far)).alias("awareness_so_far"),
        share(F.sum(gap).over(so_far), F.sum(n).over(so_far)).alias("mean_gap_so_far"),
    )
