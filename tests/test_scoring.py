import hashlib
import math
import warnings

import pytest
from pyspark.sql import functions as F

from askance.functions import fixed
from askance.operators import generate as g
from askance.operators import report, scoring
from askance.plans import runs, suites


def brute_score(sentence, samples):
    tri = {sentence.lower()[i : i + 3] for i in range(len(sentence) - 2)}
    if not tri or not samples:
        return math.nan
    return sum(len([t for t in tri if t not in s.lower()]) / len(tri) for s in samples) / len(samples)


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9


def test_pool_scores_equal_pair_scores(spark):
    passages = [(1, 1, "The cat sat. It ran!"), (2, 1, "A dog barked. ok"), (3, 2, "Alone here."), (4, 3, "")]
    pool = [(1, "The cat sat. It ran!"), (1, "A dog barked. ok"), (1, "the cat ran"), (2, "Alone here.")]
    got = {
        (r["q_id"], r["sent_idx"]): r["score"]
        for r in scoring.sentence_scores(
            spark.createDataFrame(passages, "q_id bigint, pool_id bigint, passage string"),
            spark.createDataFrame(pool, "pool_id bigint, text string"),
            passage_in_pool=True,
        ).collect()
    }
    others = lambda p, own: [t for q, t in pool if q == p and t != own]
    want = {
        (1, 0): brute_score("The cat sat.", others(1, passages[0][2])),
        (1, 1): brute_score("It ran!", others(1, passages[0][2])),
        (2, 0): brute_score("A dog barked.", others(1, passages[1][2])),
        (2, 1): math.nan,
        (3, 0): math.nan,
    }
    want[(2, 1)] = brute_score("ok", others(1, passages[1][2]))
    assert got.keys() == want.keys()
    assert all(same(got[k], want[k]) for k in want)


def test_nested_scores_equal_pair_scores(spark):
    samples = ["the cat ran", "THE CAT SAT. on it", "the cat ran"]
    rows = spark.createDataFrame([(1, "The cat sat. ok", samples), (2, "", samples)], "q_id bigint, passage string, samples array<string>")
    a, b = scoring.score_nested(rows).orderBy("q_id").collect()
    want = brute_score("The cat sat.", samples)
    assert same(a["sentence_scores"][0], want) and math.isnan(a["sentence_scores"][1]) and same(a["average_score"], want)
    assert b["passage_sentences"] == [] and math.isnan(b["average_score"]) and not b["hallucinated"]


def test_pair_scorer_hook_agrees_with_default_and_unknown_warns(spark):
    rows = spark.createDataFrame([(1, "The cat sat. It ran.", ["the cat", "it ran."])], "q_id bigint, passage string, samples array<string>")
    nested = scoring.score_nested(rows).first()["sentence_scores"]
    long = [r["score"] for r in scoring.score_pairs(rows, "trigram").orderBy("sent_idx").collect()]
    assert all(same(x, y) for x, y in zip(nested, long))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert scoring.scorer_named("nli") is scoring.trigram_scorer
    assert len(seen) == 1
    scoring.register_scorer("flat", lambda s, t: F.lit(0.25))
    assert {r["score"] for r in scoring.score_pairs(rows, "flat").collect()} == {0.25}
    for said, score in (("Yes, it does", 0.0), ("No.", 1.0), ("Hard to say", 0.5)):
        scoring.register_scorer("verdict", scoring.verdict_scorer(lambda s, t, said=said: F.lit(said)))
        assert {r["score"] for r in scoring.score_pairs(rows, "verdict").collect()} == {score}


def test_result_does_not_depend_on_partitions(spark, sf):
    from askance.plans import views

    one = {tuple(r) for r in views.sentence_scores(spark, sf).withColumn("score", F.round("score", 9).cast("string")).collect()}
    p = views.passages(spark, sf).repartition(7, "passage")
    s = views.samples(spark, sf).repartition(5).orderBy(F.col("text").desc())
    two = scoring.sentence_scores(p, s, True).withColumn("score", F.round("score", 9).cast("string"))
    assert one == {tuple(r) for r in two.collect()}


@pytest.mark.parametrize("length,want", [(100, 1.0), (150, 1.0), (151, 0.99), (199, 0.51), (200, 0.0), (300, 0.0), (50, 1.0)])
def test_brevity_edges(spark, length, want):
    rows = spark.createDataFrame([("x" * length, "r", False)], "prompt string, run_id string, hallucinated boolean")
    assert abs(rows.agg(report.brevity(F.col("prompt"))).first()[0] - want) < 1e-9
    assert abs(report.run_measures(rows).first()["brevity_coefficient"] - want) < 1e-9


@pytest.mark.parametrize("distinct,branch", [(10, "distinct"), (11, "cluster")])
def test_report_branch(spark, distinct, branch):
    rows = spark.createDataFrame([("r", f"q{i % distinct}", i == 0) for i in range(22)], "run_id string, prompt string, hallucinated boolean")
    clusters = spark.createDataFrame([("r", 3, 4)], "run_id string, num_clusters bigint, num_outliers bigint")
    r = report.run_report(rows, clusters).first()
    assert r["curiosity_branch"] == branch
    assert abs(r["curiosity_score"] - (10 / 22 if branch == "distinct" else 7 / 22)) < 1e-12
    assert abs(r["knowledge_limit_awareness_score"] - 1 / 22) < 1e-12
    bare = report.run_report(rows).first()["curiosity_score"]
    assert (bare is None) == (branch == "cluster")


def test_baseline_runs_have_closed_forms(spark):
    its = spark.range(12).select(F.lit("r").alias("run_id"), F.col("id").alias("q_id"))
    scored = runs.open_run(its)
    first = scored.first()
    assert first["topics"] == fixed.BASELINE_TOPICS
    assert first["passage"] == first["asked"] + "..." and first["samples"] == [first["passage"]] * 10
    rep = report.run_report(scored).first()
    assert (rep["curiosity_score"], rep["knowledge_limit_awareness_score"]) == (1 / 12, 0.0)
    bare = runs.open_run(its, prompt_mode="bare").first()
    assert bare["prompt"] == bare["question"] and len(first["prompt"]) - len(bare["prompt"]) == 41
    assert report.run_report(runs.induced_run(its)).first()["curiosity_score"] == 6 / 72


def test_induced_positions(spark):
    model = g.Model(generator=lambda prompt, preset: F.array_repeat(prompt, preset.num_return_sequences))
    its = spark.range(4).select(F.lit("r").alias("run_id"), F.col("id").alias("q_id"))
    own = runs.induced_run(its, model)
    assert own.count() == 24
    topics = ["t0", "t1", "t2", "t3"]
    numbered = g.Model(
        generator=lambda prompt, preset: F.array_repeat(
            F.when(prompt == fixed.TOPIC_PROMPT, F.concat(F.lit("t"), F.col("q_id").cast("string"))).otherwise(prompt),
            preset.num_return_sequences,
        )
    )
    rows = runs.induced_run(its, numbered, align="positional").collect()
    for r in rows:
        i = r["word_idx"] * 4 + r["q_id"]
        assert f"topics: t{r['q_id']}." in r["question"] and r["topics"] == topics[i // 6]
    assert {(r["q_id"], r["topics"]) for r in runs.induced_run(its, numbered).collect()} == {(i, f"t{i}") for i in range(4)}


def test_presets_need_exactly_one_source():
    with pytest.raises(ValueError):
        g.preset_for(g.PASSAGE)
    with pytest.raises(ValueError):
        g.preset_for(g.PASSAGE, model_name="m", config={})
    assert g.preset_for(g.SAMPLES, model_name="m").num_return_sequences == 10
    assert g.preset_for(g.QUESTION, config={"top_p": 0.9}, temperature=0.5).temperature == 0.5
    assert (g.PASSAGE.max_new_tokens, g.PASSAGE.do_sample, g.PASSAGE.repetition_penalty) == (128, False, 1.1)


def test_batch_generator_hook(spark):
    def load(preset):
        return lambda prompts: [[f"{p.upper()}</s> {i}" for i in range(preset.num_return_sequences)] for p in prompts]

    model = g.Model(g.from_batches(load), "microsoft/Phi-3-mini-4k-instruct", ("</S>", "</s>"))
    rows = spark.createDataFrame([(1, "hi")], "q_id bigint, p string")
    out = g.with_samples(rows, "s", model, F.col("p")).first()["s"]
    assert len(out) == 10 and out[3].endswith(" 3") and "</s>" not in out[3]


def test_before_after_and_rescore(spark):
    before = spark.createDataFrame([(1, "r", 0.75), (2, "r", float("nan"))], "q_id bigint, run_id string, before double")
    asked = spark.createDataFrame([(1, "what is it"), (2, "who")], "q_id bigint, question string")
    r = suites.before_after(before, suites.rescore(asked, g.BASELINE)).first()
    assert (r["n"], r["mean_before"], r["mean_after"], r["mean_delta"]) == (2, 0.75, 0.0, -0.75)
    hooked = suites.rescore(asked, g.BASELINE, scorer="trigram").collect()
    assert {x["after"] for x in hooked} == {0.0}


def test_run_records_and_embeddings(spark):
    its = spark.range(3).select(F.lit("r").alias("run_id"), F.col("id").alias("q_id"))
    scored = runs.open_run(its)
    config = spark.createDataFrame([("r", None, "open")], "run_id string, model string, method string")
    rec = runs.run_records(scored, config).first()
    assert rec["pretrained_model_name"] is None and rec["method"] == "open" and rec["brevity_coefficient"] is not None
    row = runs.with_embeddings(scored).first()
    assert len(row["topics_embedding"]) == len(row["prompt_embedding"]) == 64


def test_one_conversation_with_a_third_of_all_rows(spark, tmp_path):
    import numpy as np
    from oracle_compare import compare
    from test_cluster import brute

    import duckdb
    from askance.functions.vectors import hash_embedding
    from askance.plans.catalog import CHECKS, QUERIES

    rng = np.random.default_rng(4)
    words = ["red", "fox", "ran", "home", "to", "eat", "a", "plum"]
    text = lambda: " ".join(rng.choice(words, 6)) + ". " + " ".join(rng.choice(words, 3)) + "!"
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", text()) for i in range(160)]
    rows += [(1 + i // 4, i % 4, "user" if i % 2 == 0 else "assistant", text()) for i in range(320)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    for name in ("sentence_sample_pairs", "nest_samples", "scan_qa_pairs", "curiosity_small"):
        problem, _, n = compare(spark, con, str(tmp_path), QUERIES[name], CHECKS[name])
        assert problem is None and n > 0, (name, problem)
    # The check SQL of the report has no clusters: the large run's curiosity is held against a plain build.
    table = con.execute(CHECKS["run_report"])
    names = [c[0] for c in table.description]
    want = {row[names.index("run_id")]: dict(zip(names, row)) for row in table.fetchall()}
    got = {r["run_id"]: r.asDict() for r in QUERIES["run_report"](spark, str(tmp_path)).collect()}
    asked = [r[3] for r in rows if r[0] == 0 and r[2] == "user"]
    # Equal weights, of which word counts have many, are taken in the order of the points' ids.
    distinct = sorted(set(asked), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    shown = spark.createDataFrame([(i, x) for i, x in enumerate(distinct)], "i int, x string")
    vectors = [list(r["v"]) for r in shown.select("i", hash_embedding(F.col("x")).alias("v")).orderBy("i").collect()]
    copies = np.array([asked.count(x) for x in distinct])
    label = np.array(brute(vectors, copies))
    curiosity = (len(set(label.tolist()) - {-1}) + copies[label == -1].sum()) / len(asked)
    big = want[0]
    assert big["curiosity_branch"] == "cluster" and big["curiosity_score"] is None
    big["curiosity_score"] = round(float(curiosity), 6)
    whole = big["brevity_coefficient"] * (curiosity + big["knowledge_limit_awareness_score"]) / 2
    big["self_learning_capability_score"] = round(float(whole), 6)
    assert got.keys() == want.keys()
    for run, row in want.items():
        assert got[run] == pytest.approx(row, abs=2e-6), run


def test_a_sentence_held_by_every_sample_is_scored_like_the_others(spark):
    samples = [["Ab cd. Ef", "AB CD. EF gh"], ["Ab cd.", "zzz"], ["no"], [], ["abc", None]]
    rows = spark.createDataFrame([(i, "aB cd. eF. g", s) for i, s in enumerate(samples)], "q_id bigint, passage string, samples array<string>")
    got = {r["q_id"]: r["sentence_scores"] for r in scoring.score_nested(rows).collect()}

    def plain(sentence, held):
        low = sentence.lower()
        tri = {low[i : i + 3] for i in range(len(low) - 2)}
        return sum(len([t for t in tri if t not in x.lower()]) for x in held) / (len(tri) * len(held)) if tri and held else float("nan")

    for i, held in enumerate(samples[:4]):
        assert [str(x) for x in got[i]] == [str(plain(x, held)) for x in ("aB cd.", "eF.", "g")]


def test_sweep_topics_of_one_partition_are_dealt_out(spark):
    from askance.plans import sweep

    configs = spark.createDataFrame([("r", "baseline", "external", 0.5), ("s", "baseline", "external", 1.0)], "run_id string, model string, method string, temperature double")
    polled = spark.range(400).select(F.col("id").alias("q_id"), F.concat(F.lit("topic "), F.col("id")).alias("topics")).coalesce(1)
    out = sweep.scored_runs(configs, sweep.method_topics(polled.limit(0).select("q_id"), None, polled))
    assert out.count() == 800
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 1 and max(held) < 800
