from pyspark.sql import functions as F

from askance.operators import report
from askance.plans import runs
from askance.sources import tables as t
from askance.streaming import trends


def work(batch):
    return runs.trending_run(trends.poll_topics(batch)).select("run_id", "q_id", "topics", "prompt", "hallucinated")


def test_stream_equals_batch_on_closed_hours_and_restarts_clean(spark, sf, tmp_path):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    counts = trends.hourly_counts(trends.event_stream(spark, sf))
    trends.run_stream(counts, work, out, marks, once=True).awaitTermination(120)
    streamed = {(r["q_id"], r["topics"], r["prompt"]) for r in spark.read.parquet(out).collect()}
    batch = work(trends.hourly_counts(t.topic_events(t.table(spark, sf, "events"))))
    last = batch.agg(F.max("run_id")).first()[0]
    closed = {(r["q_id"], r["topics"], r["prompt"]) for r in batch.filter(F.col("run_id") < last).collect()}
    assert streamed == closed and streamed
    # all over again from the same checkpoint: nothing new
    again = trends.hourly_counts(trends.event_stream(spark, sf))
    trends.run_stream(again, work, out, marks, once=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == len(streamed)
    sums = trends.hourly_sums(spark.read.parquet(out))
    rows = trends.scores_so_far(sums).orderBy("run_id").collect()
    assert rows[-1]["n_so_far"] == len(streamed) and rows[-1]["awareness_so_far"] == 0.0
    per_hour = {r["run_id"]: r["knowledge_limit_awareness_score"] for r in report.run_measures(spark.read.parquet(out)).collect()}
    assert per_hour == {r["run_id"]: r["awareness"] for r in rows}


def test_top_topics_per_hour(spark):
    rows = [(f"2024-01-01 00:{i % 60:02d}:00", f"t{i % 150:03d}") for i in range(300)] + [("2024-01-01 00:30:00", "t149")]
    events = spark.createDataFrame(rows, "ts string, title string").select(F.col("ts").cast("timestamp").alias("ts"), "title")
    top = trends.top_topics(trends.hourly_counts(events)).orderBy("rank").collect()
    assert len(top) == 100 and top[0]["title"] == "t149" and top[1]["title"] == "t000"
