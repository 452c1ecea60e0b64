"""Scores over all polls so far, kept as a stream's keyed state.

A run's polls come as one row of sums each (``trends.hourly_sums``, or ``poll_sums`` of any scored questions), in any
number of micro-batches. The state of a run maps each poll to its sums; a poll that comes again, as after a replay,
takes its own place and is not counted twice, and one that comes late moves the scores of the polls behind it. Each
batch puts out the polls whose scores changed, to be read over those put out before (``latest``).

State lives in the checkpoint: a stream that is stopped and started again goes on where it was. A run's state is a
few numbers per poll; questions and their texts never enter it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import fixed
from ..operators import report
from ..operators.order import first_per_group

SUMS = "run_id string, poll string, n bigint, n_hallucinated bigint, gap_sum bigint"
SO_FAR = "run_id string, poll string, n bigint, n_hallucinated bigint, gap_sum bigint, n_so_far bigint, hallucinated_so_far bigint, gap_so_far bigint"
_POLLS = "poll array<string>, n array<bigint>, n_hallucinated array<bigint>, gap_sum array<bigint>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def poll_sums(scored: DataFrame, run: Column, poll: Column) -> DataFrame:
    """One row of sums per run and poll; tasks add up their own rows first, so a poll of any size is one row."""
    gap = F.abs(F.length("prompt") - fixed.IDEAL_QUESTION_CHARS).cast("bigint")
    return scored.groupBy(run.cast("string").alias("run_id"), poll.cast("string").alias("poll")).agg(
        F.count("*").alias("n"), F.count_if("hallucinated").alias("n_hallucinated"), F.sum(gap).alias("gap_sum")
    )


class RunningSums(StatefulProcessor):
    """Per run the sums of each poll; puts out every poll from the first changed one on.

    The polls are one value: a batch reads and writes a run once, where an entry per poll is a call to the
    state store each.
    """

    def init(self, handle) -> None:
        self._polls = handle.getValueState("polls", _POLLS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        changed = {}
        for part in rows:
            columns = (part["poll"], part["n"], part["n_hallucinated"], part["gap_sum"])
            changed |= {p: (int(n), int(h), int(g)) for p, n, h, g in zip(*columns)}
        if not changed:
            return
        held = self._polls.get()
        polls = dict(zip(held[0], zip(*held[1:]))) if held else {}
        polls |= changed
        named = sorted(polls)
        self._polls.update((named, *[list(numbers) for numbers in zip(*[polls[p] for p in named])]))
        first = min(changed)
        out, so_far = [], [0, 0, 0]
        for poll in named:
            sums = polls[poll]
            so_far = [a + b for a, b in zip(so_far, sums)]
            if poll >= first:
                out.append((key[0], poll, *sums, *so_far))
        names = [part.split()[0] for part in SO_FAR.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """Keyed state needs this store; the setting is read as a stream starts, and put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def start(sums: DataFrame, out: str, checkpoint: str, once: bool = False, every: str = "1 hour"):
    """Start the stream over ``sums`` (run_id, poll, n, n_hallucinated, gap_sum) into ``out``.

    A batch is written under its own number and overwritten when it is replayed. With ``once`` the stream ends when
    the waiting rows are used up, else batches come at intervals.
    """
    states = sums.groupBy("run_id").transformWithStateInPandas(RunningSums(), SO_FAR, "Update", "None")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    with _state_in_rocksdb(sums.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_sums(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream of the sums that arrive in ``folder``."""
    reader = spark.readStream.schema(SUMS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The scores so far as last put out, one row per run and poll.

    ``brevity_so_far`` follows the run report's rule, ``awareness_so_far`` is the doubtful share; both are of all
    questions of the run up to and with the poll.
    """
    rows = spark.read.schema(f"{SO_FAR}, batch bigint").parquet(out)
    last = first_per_group(rows, ["run_id", "poll"], [F.col("batch").desc()], 1, "_age").drop("_age", "batch")
    n = F.col("n_so_far").cast("double")
    gap = F.try_divide(F.col("gap_so_far").cast("double"), n)
    return last.select(
        "run_id", "poll", "n",
        F.try_divide(F.col("n_hallucinated").cast("double"), F.col("n").cast("double")).alias("awareness"),
        F.try_divide(F.col("gap_sum").cast("double"), F.col("n").cast("double")).alias("mean_gap"),
        "n_so_far",
        F.try_divide(F.col("hallucinated_so_far").cast("double"), n).alias("awareness_so_far"),
        gap.alias("mean_gap_so_far"),
        report.brevity_of(gap).alias("brevity_so_far"),
    )
