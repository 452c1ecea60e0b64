import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from askance.functions import text as tx
from askance.functions import vectors as v
from askance.operators import judge, neighbours, order, pairs, retrieval, routing, tokens
from askance.plans import training
from askance.sources import store


@pytest.mark.parametrize("n,batch", [(10, 3), (1, 4), (12, 4), (101, 7)])
def test_batches_like_array_split(spark, n, batch):
    rows = spark.range(n).select((F.col("id") * 7 % 1009).alias("k"))
    got = [r["batch_id"] for r in order.with_batches(rows, "k", batch, rows_per_bucket=4).orderBy("k").collect()]
    parts = np.array_split(np.arange(n), -(-n // batch))
    assert got == [i for i, p in enumerate(parts) for _ in p]


def test_position_over_buckets_equals_plain(spark):
    rows = spark.range(500).select((F.xxhash64("id") / 1000).cast("bigint").alias("k"))
    got, n = order.with_position(rows, "k", rows_per_bucket=20)
    got = got.orderBy("k").collect()
    assert n == 500 and [r["pos"] for r in got] == list(range(500))


def test_slices_round_trip(spark, tmp_path):
    rows = spark.range(23).select(F.col("id").alias("k"))
    sliced = order.with_slices(rows, "k")
    assert sorted(r["slice"] for r in sliced.collect()) == [i // 3 for i in range(23)]
    store.write_slices(sliced, str(tmp_path / "s"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == list(range(23))


def test_sample_batch_size():
    assert [order.sample_batch_size(b) for b in (256, 128, 20, 10, 1)] == [25, 12, 2, 2, 2]


def test_seeded_sample_is_stable(spark):
    rows = spark.range(300).select(F.col("id").alias("k"))
    one = {r["k"] for r in order.seeded_sample(rows, "k", 40).collect()}
    assert len(one) == 40 and one == {r["k"] for r in order.seeded_sample(rows.repartition(9), "k", 40).collect()}


def test_stage_store(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    a = store.stage_path(str(tmp_path), "topics", model="m", temperature=0.0)
    b = store.stage_path(str(tmp_path), "topics", model="m", temperature=1.0)
    assert a != b
    assert store.materialize(spark, make, a, True).count() == 1
    assert store.materialize(spark, make, a, True).count() == 1 and len(calls) == 1
    assert store.materialize(spark, make, a, False).count() == 2
    assert store.materialize(spark, make, b, True).count() == 3


def test_runs_round_trip(spark, tmp_path):
    rows = [("r1", "a/b.c", "open", 0.5, 0.1, 1.0, 0.3), ("r2", None, "induced", 0.5, 0.1, 1.0, 0.3)]
    ddl = "run_id string, pretrained_model_name string, method string, curiosity_score double, " \
        "knowledge_limit_awareness_score double, brevity_coefficient double, self_learning_capability_score double"
    store.write_runs(spark.createDataFrame(rows, ddl), str(tmp_path / "runs"))
    back = {tuple(r[c] for c in ("run_id", "pretrained_model_name", "method")) for r in store.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert back == {("r1", "a/b.c", "open"), ("r2", None, "induced")}
    assert (tmp_path / "runs" / "method=open" / "model_key=a_b_c").exists()


def test_metric_sink(spark, tmp_path):
    wide = spark.createDataFrame([("r", 0.5, 2)], "run_id string, bleu double, n bigint")
    rows = store.metric_rows(wide, "qa", "learned_", ["bleu", "n"])
    store.append_metrics(rows, str(tmp_path / "m"))
    store.append_metrics(rows, str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.count() == 4 and {r["metric"] for r in got.collect()} == {"learned_bleu", "learned_n"}


def test_left_join_keeps_and_fans_out(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "prompt string, x int")
    preds = spark.createDataFrame([("a", "p"), ("a", "p"), ("c", "q")], "prompt string, passage string")
    got = sorted((r["prompt"], r["x"], r["passage"]) for r in pairs.left_join_skewed(docs, preds, "prompt").collect() if r["passage"])
    assert got == [("a", 1, "p"), ("a", 1, "p")]
    assert pairs.left_join_skewed(docs, preds, "prompt").filter("passage is null").count() == 1


def test_preference_rule(spark):
    rows = [("q", s, " own ", " better ") for s in (1.0, 0.5, 0.0, -99.0)] + [("q", 0.0, None, "b")]
    train = spark.createDataFrame(rows, "prompt string, similarity double, passage string, answer_text string")
    got = [(r["chosen"], r["rejected"]) for r in pairs.preference_pairs(train, lambda p: p).collect()]
    assert got == [("own", "-")] + [("better", "own")] * 3 + [("b", "-")]


def test_answers_distinct_before_strip(spark):
    asked = spark.createDataFrame([("a",), ("a ",), ("a",)], "prompt string")
    frame = training.from_answers(judge.stronger_answers(asked, lambda p: F.upper(p)), asked.select("prompt", F.lit("x").alias("passage")).limit(1))
    assert sorted(r["prompt"] for r in frame.collect()) == ["a", "a"]
    again = training.rejudge(frame, lambda p, gold, answer: F.lit("Yes")).collect()
    assert {r["similarity"] for r in again} == {1.0}


def test_length_budget(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(1, words(10), words(20), words(30)), (2, words(300), words(250), words(10)), (3, words(300), words(400), words(10))]
    out = tokens.length_budget(spark.createDataFrame(rows, "i int, p string, c string, r string"), "p", "c", "r").orderBy("i").collect()
    assert [(r["over_budget"], len(r["prompt_ids"]), len(r["chosen_ids"]), len(r["rejected_ids"])) for r in out] == [
        (False, 10, 20, 30), (True, 256, 250, 10), (True, 256, 256, 10)]


def test_fixed_length(spark):
    rows = spark.createDataFrame([([1, 2],), (list(range(1, 301)),)], "ids array<int>")
    a, b = rows.select(tokens.fix_length(F.col("ids")), tokens.fixed_mask(F.col("ids"))).collect()
    assert a[0] == [1, 2] + [0] * 254 and sum(a[1]) == 2 and len(b[0]) == 256 and sum(b[1]) == 256


def brute_search(questions, pages, k=10):
    words = {p: set(t.lower().split()) for p, _, t in pages}
    df = {}
    for ws in words.values():
        for w in ws:
            df[w] = df.get(w, 0) + 1
    weight = {w: round(math.log((len(pages) + 1) / n) * 1_000_000) for w, n in df.items()}
    out = {}
    for q, text in questions:
        scored = []
        for p, ws in words.items():
            shared = [weight[w] for w in set(text.lower().split()) & ws]
            if shared:
                scored.append((-sum(shared), p))
        out[q] = [p for _, p in sorted(scored)[:k]]
    return out


def test_search_is_exact_with_a_crowd_of_copies(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)]
    pages = [(i, f"u{i}", "same copy text w1 w2") for i in range(30)]
    pages += [(100 + i, f"u{100 + i}", " ".join(rng.choice(vocab, 6))) for i in range(60)]
    questions = [(i, " ".join(rng.choice(vocab + ["same", "unseen"], 4))) for i in range(40)]
    questions += [(50, "same copy text"), (51, "w1 w2 same copy text w3"), (52, "unseen"), (53, ""), (54, " ".join(vocab))]
    found = retrieval.lexical_search(spark.createDataFrame(pages, "page_id bigint, url string, full_text string"))(
        spark.createDataFrame(questions, "q_id bigint, prompt string")
    )
    got = {}
    for r in found.orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["page_id"])
    assert got == {q: p for q, p in brute_search(questions, pages).items() if p}


def test_curated_rows_and_failures(spark):
    pages = spark.createDataFrame([(1, "u1", "Cats purr. Dogs bark loudly."), (2, "u2", "dogs")], "page_id bigint, url string, full_text string")
    asked = spark.createDataFrame([(7, "do dogs bark")], "q_id bigint, prompt string")
    rows = retrieval.curate(asked, pages, retrieval.lexical_search(pages)).orderBy("page_id").collect()
    assert rows[0]["answer_text"] == "Dogs bark loudly." and abs(rows[0]["answer_score"] - 2 / 3) < 1e-12
    hook = lambda q: q.select("q_id", F.lit(1).cast("bigint").alias("page_id"), F.lit("u1").alias("url"), F.lit(1).alias("rank"))
    odd = spark.createDataFrame([(8, "zebra")], "q_id bigint, prompt string")
    found = retrieval.curate(odd, pages, hook)
    assert retrieval.succeeded(found).count() == 0 and retrieval.failed(found).count() == 1


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 5))
    x[60:100] = x[0]  # a third are copies of one vector
    vocab = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "term_id bigint, embedding array<double>")
    points = vocab.filter("term_id % 3 = 0").select(F.col("term_id").alias("q_id"), F.col("embedding").alias("vector"))
    want = {}
    for i in range(0, 120, 3):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want[i] = sorted(range(120), key=lambda j: (d[j], j))[:10]

    def lists(df):
        out = {}
        for r in df.orderBy("q_id", "rank").collect():
            out.setdefault(r["q_id"], []).append(r["term_id"])
        return out

    assert lists(neighbours.nearest(points, vocab)) == want
    assert lists(neighbours.nearest(points, vocab, block=16)) == want
    assert lists(neighbours.nearest(points.limit(0), vocab)) == {}


def test_neighbours_of_larger_blocks():
    # A row's copies do not grow with the table up to eight full blocks: a tenfold table moves ten times as much.
    assert neighbours._sides(10_000, neighbours.BLOCK) == neighbours._sides(100_000, neighbours.BLOCK) == 8
    assert neighbours._sides(0, 16) == 1 and neighbours._sides(600_000, neighbours.BLOCK) == 19
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 6))
    x[1000:3000] = x[5]
    x[3000:3500] = x[6] + 1e-9 * rng.normal(size=(500, 6))  # closer than single precision can tell
    x[10], x[11, 2], x[12, 3] = 1e-30, np.nan, np.inf
    ids = rng.permutation(6000)
    asked = [5, 6, 10, 3400, 4000]
    got, dist = neighbours.block_best(x[asked], ids, x, 10)
    for i, found, far in zip(asked, got, dist):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = np.lexsort((ids, d))[:10]
        assert found.tolist() == ids[want].tolist() and far.tolist() == d[want].tolist()


def test_topic_pick(spark):
    near = spark.createDataFrame([(1, i, 0.1 * i, i + 1) for i in range(10)], "q_id bigint, term_id bigint, distance double, rank int")
    vocab = spark.createDataFrame([(i, f"big_cat{i} ### def") for i in range(10)], "term_id bigint, term string")
    topics = neighbours.pick_topics(near, vocab, 42).first()["topics"].split(", ")
    assert len(set(topics)) == 3 and all(t.startswith("big cat") for t in topics)


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, -3.0], [2.0, -6.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    out = rows.select(v.l1_normalize(F.col("a")).alias("n"), v.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert out[0]["n"] == [0.25, -0.75] and abs(out[0]["c"] - 1) < 1e-12 and out[1]["c"] is None
    e = spark.createDataFrame([("b a b",), ("",)], "t string").select(v.hash_embedding(F.col("t"), 16)).collect()
    assert abs(sum(x * x for x in e[0][0]) - 1) < 1e-12 and sum(e[1][0]) == 0


def test_random_points_are_fixed_and_normal(spark):
    ids = spark.range(200).select(F.col("id").alias("q_id"))
    one = neighbours.random_points(ids, 32, 1).orderBy("q_id").collect()
    two = neighbours.random_points(ids.repartition(5), 32, 1).orderBy("q_id").collect()
    assert one == two
    x = np.array([r["vector"] for r in one])
    assert np.allclose(np.abs(x).sum(1), 1) and abs(x.mean()) < 0.003 and len(np.unique(x)) == x.size


def test_router(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(3 * (i % 2), 0.5, 4)], i % 2) for i in range(80)]
    data = spark.createDataFrame(rows, "vec_id bigint, e array<double>, label int")
    out = routing.route(data, "vec_id", "e", routing.fit_router(data, "e"), ["base", "adapter"]).collect()
    assert sum(r["route"] == r["label"] for r in out) >= 78
    assert all(r["variant"] == ["base", "adapter"][r["route"]] and r["is_known_route"] for r in out)
    short = routing.route(data, "vec_id", "e", routing.fit_router(data, "e"), ["base"]).collect()
    assert {(r["route"], r["variant"], r["is_known_route"]) for r in short} == {(0, "base", True), (1, None, False)}


def test_positions_of_no_rows_and_of_few(spark):
    none, n = order.with_position(spark.createDataFrame([], "k bigint"), "k")
    assert n == 0 and none.count() == 0
    few, n = order.with_position(spark.createDataFrame([(30,), (10,), (20,)], "k bigint"), "k")
    assert n == 3 and [(r["k"], r["pos"]) for r in few.orderBy("k").collect()] == [(10, 0), (20, 1), (30, 2)]


def test_judges_are_told_what_to_decide(spark):
    row = spark.createDataFrame([("q?", "gold", "answer")], "p string, g string, a string")

    def call(m):
        return F.concat_ws(" | ", m["system"], m["user"])

    seen = row.select(
        judge.instructed_judge(call)(F.col("p"), F.col("g"), F.col("a")).alias("j"),
        judge.instructed_relevance(call)(F.col("p"), F.col("g")).alias("r"),
        judge.instructed_answerer(call)(F.col("p")).alias("w"),
    ).first()
    assert "YES - if the answer" in seen["j"] and seen["j"].endswith("###SYSTEM_ANSWER: answer")
    assert "PARTLY - if the the article" in seen["r"] and seen["r"].endswith("###CONTEXT: gold")
    assert seen["w"].endswith(" domains. | q?")


def test_token_numbers_keep_words_apart(spark):
    words = spark.range(200_000).select(tx.token_id(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("n"))
    assert words.distinct().count() == 200_000


def test_short_texts_are_set_aside(spark):
    rows = spark.createDataFrame([("",), ("one",), ("two words",)], "t string")
    assert [r["reason"] is None for r in tokens.check_length(rows, "t").collect()] == [False, True, True]
    assert [r["reason"] is None for r in tokens.check_length(rows, "t", start_token=False).collect()] == [False, False, True]


def test_judges(spark):
    row = spark.createDataFrame([("who", "the red fox ran", "the red fox ran"), ("who", "abc", "")], "p string, g string, a string")
    got = [r[0] for r in row.select(judge.lexical_judge(F.col("p"), F.col("g"), F.col("a"))).collect()]
    assert got == ["YES", "NO"]
    seen = row.select(judge.judge_by(lambda m: m)(F.col("p"), F.col("g"), F.col("a"))).first()[0]
    assert seen == "###PROMPT: who\n\n###GOLD_ANSWER: the red fox ran\n\n###SYSTEM_ANSWER: the red fox ran"
