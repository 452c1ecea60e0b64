"""Growing stages, idempotent metric rows, configurations as rows, rollups."""

import pytest
from pyspark.sql import functions as F

from askance.operators import generate as g
from askance.operators import report, routing
from askance.plans import runs, sweep
from askance.sources import increment, store


def stage_of(spark, path):
    """A stage that counts words, and the list of inputs it was handed."""
    handed = []

    def make(rows):
        handed.append(sorted(r.id for r in rows.collect() if r.id is not None))
        return rows.filter("text <> ''").select(increment.KEY, F.explode(F.split("text", " ")).alias("word"))

    return increment.Stage(path, "v1"), make, handed


def texts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string")


def words_of(rows):
    return sorted((r.id, r.word) for r in rows.collect())


def test_only_new_and_changed_keys_are_computed(spark, tmp_path):
    stage, make, handed = stage_of(spark, str(tmp_path))
    assert words_of(stage.extend(texts(spark, [(1, "a b"), (2, ""), (3, "c"), (3, "c")]), ["id"], make)) == [(1, "a"), (1, "b"), (3, "c")]
    # 1 changes, 3 goes, 4 is new, and 2, for which no row was made, is not tried again
    again = stage.extend(texts(spark, [(1, "a x"), (2, ""), (4, "d"), (None, "n")]), ["id"], make)
    assert sorted(((r.id is None, r.id, r.word) for r in again.collect()), key=str) == sorted([(False, 1, "a"), (False, 1, "x"), (False, 4, "d"), (True, None, "n")], key=str)
    # back to the first text of 1: it is still stored
    assert words_of(stage.extend(texts(spark, [(1, "a b"), (2, "")]), ["id"], make)) == [(1, "a"), (1, "b")]
    assert handed == [[1, 2, 3], [1, 4], []]
    assert len(stage.parts(spark)) == 2


def test_a_part_that_was_not_committed_is_not_read(spark, tmp_path):
    stage, make, handed = stage_of(spark, str(tmp_path))

    def dies(rows):
        return make(rows).withColumn("word", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        stage.extend(texts(spark, [(1, "a")]), ["id"], dies)
    assert stage.parts(spark) == []
    assert words_of(stage.extend(texts(spark, [(1, "a")]), ["id"], make)) == [(1, "a")]
    other = increment.Stage(str(tmp_path), "v2")
    assert words_of(other.extend(texts(spark, [(1, "a")]), ["id"], make)) == [(1, "a")] and handed == [[1], [1], [1]]


def test_pooled_features_are_means_of_sentences(spark):
    rows = spark.createDataFrame([(1, "a b. c d."), (2, ""), (3, None)], "q_id bigint, t string")

    def embed(s):
        return F.array(F.length(s).cast("double"), F.lit(1.0))

    got = routing.text_features(rows, "t", embed, 2).collect()
    assert [(r.q_id, r.n_parts, r.features) for r in got] == [(1, 2, [4.0, 1.0])]


def test_a_replayed_batch_leaves_metrics_unchanged(spark, tmp_path):
    path = str(tmp_path)
    wide = spark.createDataFrame([("r1", 1.0, 2.0), ("r2", 3.0, 4.0)], "run_id string, a double, b double")
    rows = store.metric_rows(wide, "run", "learned_", ["a", "b"])

    def held():
        return sorted((r.run_id, r.metric, r.value, r.batch) for r in increment.read_metrics(spark, path).collect())

    increment.put_metrics(rows, path, "0")
    increment.put_metrics(rows, path, "1")
    both = held()
    assert len(both) == 8
    increment.put_metrics(rows, path, "0")
    assert held() == both
    # one run's batch again with another value: that run's rows alone are replaced
    changed = store.metric_rows(wide.filter("run_id = 'r1'").withColumn("a", F.lit(9.0)), "run", "learned_", ["a", "b"])
    increment.put_metrics(changed, path, "1")
    assert held() == sorted([x for x in both if x[0] != "r1" or x[3] != "1"] + [("r1", "learned_a", 9.0, "1"), ("r1", "learned_b", 2.0, "1")])


CONFIG = "run_id string, model string, method string, temperature double"


def topics_of(spark):
    some = spark.createDataFrame([(1, "x"), (2, "y")], "q_id bigint, topics string")
    return sweep.method_topics(spark.range(3).withColumnRenamed("id", "q_id"), some, some)


def test_every_configuration_is_its_own_run(spark):
    configs = spark.createDataFrame(
        [("a", "baseline", "open", 0.5), ("b", "loud", "induced", 2.0), ("c", "loud", "oracle", 1.0), ("d", "baseline", "external", 1.0), ("e", "x", "none", 1.0)], CONFIG
    )

    def loud(prompt, preset):
        heat = preset.temperature if preset.temperature is not None else F.lit(0.0)
        told = F.concat(F.upper(prompt), F.lit(" "), (heat if not isinstance(heat, float) else F.lit(heat)).cast("string"))
        return F.array_repeat(told, preset.num_return_sequences)

    scored = sweep.scored_runs(configs, topics_of(spark), {"loud": g.Model(loud)}).cache()
    counts = {r.run_id: r["count"] for r in scored.groupBy("run_id").count().collect()}
    assert counts == {"a": 3, "b": 18, "c": 2, "d": 2}
    asked = {r.run_id: r.question for r in scored.filter("q_id < 2").orderBy("q_id", F.desc("word_idx")).collect()}
    assert asked["b"].endswith(" 2.0") and asked["b"] == asked["b"].upper() and asked["a"].endswith("...")
    assert scored.filter("run_id = 'd' AND prompt <> question").count() == 0
    assert scored.filter("run_id = 'a' AND prompt <> asked").count() == 0
    # the same rows as a run of its own
    own = runs.open_run(spark.range(3).select(F.lit("a").alias("run_id"), F.col("id").alias("q_id")))
    assert sorted(r.prompt for r in own.collect()) == sorted(r.prompt for r in scored.filter("run_id = 'a'").collect())


def test_plan_does_not_grow_with_configurations(spark):
    def size(n):
        configs = spark.range(n).select(
            F.col("id").cast("string").alias("run_id"), F.lit("baseline").alias("model"),
            F.element_at(F.array(*[F.lit(m) for m in sweep.METHODS]), (F.col("id") % 4 + 1).cast("int")).alias("method"), F.lit(1.0).alias("temperature"),
        )
        plan = sweep.scored_runs(configs, topics_of(spark))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("\n")

    assert size(1) == size(500)


def test_rollup_levels_tell_subtotals_from_null_groups(spark):
    rows = [("m1", "open", 1, "q" * 100, True), ("m1", None, 2, "q" * 160, False), ("m2", "open", 3, "q" * 300, True), ("m2", "open", 3, "q" * 100, False)]
    scored = spark.createDataFrame(rows, "model string, method string, run_id int, prompt string, hallucinated boolean")
    got = {(r.level, r.model, r.method): r for r in report.rollup_report(report.run_sums(scored, "model", "method"), "model", "method").collect()}
    assert set(got) == {(2, "m1", "open"), (2, "m1", None), (2, "m2", "open"), (1, "m1", None), (1, "m2", None), (0, None, None)}
    total = got[0, None, None]
    assert (total.n_runs, total.n_questions, total.n_hallucinated, total.knowledge_limit_awareness_score) == (3, 4, 2, 0.5)
    assert total.brevity_coefficient == pytest.approx(1.5 - 65 / 100) and got[1, "m2", None].brevity_coefficient == 0.0
    assert report.rollup_report(report.run_sums(scored.limit(0), "model", "method"), "model", "method").count() <= 1


def test_config_sweep_asks_about_every_vector(spark, tmp_path):
    import datetime

    import duckdb
    from oracle_compare import compare

    from askance.plans.catalog import CHECKS, QUERIES
    from askance.schema import TABLES

    rows = {
        "embeddings": [(i, [float(i), float(i % 3), 1.0], i % 2) for i in range(1, 14)],
        "part": [(2, "cold widget", "Brand#1", "ECONOMY", 1, 1.0)],
        "conversations": [(1, 0, "user", "why?"), (1, 1, "assistant", "because.")],
        "events": [(1, datetime.datetime(2024, 1, 1), 1, "error", 1.0, '{"k": 87}')],
    }
    con = duckdb.connect()
    for name, made in rows.items():
        spark.createDataFrame(made, TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    problem, _, n = compare(spark, con, str(tmp_path), QUERIES["config_sweep"], CHECKS["config_sweep"])
    assert problem is None and n == 16
    asked = {r.run_id: r.n_questions for r in QUERIES["config_sweep"](spark, str(tmp_path)).collect()}
    assert asked["baseline|oracle|0.5"] == 13
