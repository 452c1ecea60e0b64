"""Keyed stream state and distinct sketches against counts over all rows."""

import pytest
from pyspark.sql import functions as F

from askance.operators import sketches
from askance.plans import runs
from askance.sources import tables as t
from askance.streaming import running, trends

ROWS = "run_id string, poll string, n bigint, n_hallucinated bigint, gap_sum bigint"


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sums = running.read_sums(spark, str(tmp_path / "in"), files_per_batch=1)
    running.start(sums, str(tmp_path / "out"), str(tmp_path / "marks"), once=True).awaitTermination(300)
    found = running.latest(spark, str(tmp_path / "out")).collect()
    assert len({(r.run_id, r.poll) for r in found}) == len(found)
    return {(r.run_id, r.poll): (r.n_so_far, r.awareness_so_far, r.mean_gap_so_far) for r in found}


def test_restart_late_and_repeated_polls(spark, tmp_path):
    first = feed(spark, tmp_path, [("a", "1", 4, 1, 40), ("a", "3", 6, 3, 120), ("b", "1", 1, 0, 5)])
    assert first == {("a", "1"): (4, 0.25, 10.0), ("a", "3"): (10, 0.4, 16.0), ("b", "1"): (1, 0.0, 5.0)}
    # a new stream on the same checkpoint: one poll comes late, one comes again, one is replaced
    again = feed(spark, tmp_path, [("a", "2", 10, 10, 0), ("a", "1", 4, 1, 40), ("b", "1", 2, 2, 500)])
    assert again == {
        ("a", "1"): (4, 0.25, 10.0), ("a", "2"): (14, 11 / 14, 40 / 14), ("a", "3"): (20, 0.7, 8.0), ("b", "1"): (2, 1.0, 250.0),
    }
    brevity = {r.run_id: r.brevity_so_far for r in running.latest(spark, str(tmp_path / "out")).collect()}
    assert brevity == {"a": 1.0, "b": 0.0}
    # started once more without news: nothing changes
    sums = running.read_sums(spark, str(tmp_path / "in"))
    running.start(sums, str(tmp_path / "out"), str(tmp_path / "marks"), once=True).awaitTermination(300)
    assert running.latest(spark, str(tmp_path / "out")).count() == 4


def test_stream_equals_the_hourly_scores_after_a_restart(spark, sf, tmp_path):
    """All hours as one run: the stream's scores so far are those that the batch query has."""
    counts = trends.hourly_counts(t.topic_events(t.table(spark, sf, "events")))
    scored = runs.trending_run(trends.poll_topics(counts)).select("run_id", "prompt", "hallucinated").cache()
    want = {r.run_id: (r.n_so_far, r.awareness_so_far, r.mean_gap_so_far) for r in trends.scores_so_far(trends.hourly_sums(scored)).collect()}
    sums = [tuple(r) for r in running.poll_sums(scored, F.lit("external"), F.col("run_id")).orderBy("poll").collect()]
    half = len(sums) // 2
    feed(spark, tmp_path, sums[:half])
    got = feed(spark, tmp_path, sums[half:])
    assert {p: v for (_, p), v in got.items()} == {p: (n, a, pytest.approx(g)) for p, (n, a, g) in want.items()}


def asked(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 2).cast("string").alias("r"), (F.col("id") % 7).cast("string").alias("p"),
        F.concat(F.lit("question "), (F.xxhash64("id") % 9_000).cast("string")).alias("prompt"),
    )
    return rows.unionByName(spark.createDataFrame([("0", "1", None), ("9", "0", None)], "r string, p string, prompt string"))


def test_merged_sketches_are_within_the_stated_error(spark, tmp_path):
    rows = asked(spark)
    path = str(tmp_path / "s")
    sketches.store(sketches.sketch_polls(rows, F.col("r"), F.col("p")), path)
    kept = sketches.stored(spark, path)
    bound = sketches.relative_error()
    assert bound < 0.03
    exact = {r.r: r.d for r in rows.groupBy("r").agg(F.count_distinct("prompt").alias("d")).collect()}
    merged = {r.run_id: r for r in sketches.merged(kept, "run_id").collect()}
    for run, d in exact.items():
        assert abs(merged[run].n_distinct - d) <= max(1, bound * d)
    # any set of polls
    some = rows.filter("p IN ('2', '5')").agg(F.count_distinct("prompt")).first()[0]
    got = sketches.merged(kept.filter("poll IN ('2', '5')")).first()
    assert abs(got.n_distinct - some) <= bound * some and got.n_questions == rows.filter("p IN ('2', '5')").count()
    assert merged["9"].n_distinct == 0 and merged["9"].curiosity == 0.0
    last = {r.run_id: r.n_distinct for r in sketches.so_far(kept).filter("poll = '6'").collect()}
    assert last["1"] == merged["1"].n_distinct


def test_a_poll_sketched_again_replaces_itself_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = asked(spark)
    sketches.store(sketches.sketch_polls(rows, F.col("r"), F.col("p")), path)
    before = {(r.run_id, r.poll): r.n_questions for r in sketches.stored(spark, path).collect()}
    sketches.store(sketches.sketch_polls(rows.filter("p = '3'"), F.col("r"), F.col("p")), path)
    assert {(r.run_id, r.poll): r.n_questions for r in sketches.stored(spark, path).collect()} == before
    empty = spark.createDataFrame([], "r string, p string, prompt string")
    assert sketches.merged(sketches.sketch_polls(empty, F.col("r"), F.col("p")), "run_id").count() == 0


def test_a_run_is_read_and_written_once_per_batch():
    import pandas as pd

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return value

    value, states = Value(), running.RunningSums()
    states.init(Handle())
    polls = pd.DataFrame({"poll": [f"{i:03d}" for i in range(1, 101)], "n": 2, "n_hallucinated": 1, "gap_sum": 3})
    first = next(states.handleInputRows(("a",), iter([polls[50:], polls[10:50]]), None))
    again = next(states.handleInputRows(("a",), iter([polls[:11]]), None))
    assert value.calls == 4
    assert len(first) == 90 and first["n_so_far"].max() == 180
    assert again["poll"].tolist() == polls["poll"].tolist() and again["gap_so_far"].tolist() == [3 * i for i in range(1, 101)]
