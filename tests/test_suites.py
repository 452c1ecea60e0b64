"""Suites from prompt to metric rows, stored models, routers held out, models over batches."""

import math
import os
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askance.functions import batches
from askance.operators import generate as g
from askance.operators import judge, perplexity, routing
from askance.plans import suites

CORPUS = ["a b a b c", "a b d", "", None, "c", "e f"]


def plain_nll(text):
    """The interpolated model by its formula."""
    listed = [x.split() for x in CORPUS if x]
    one, two = Counter(w for ws in listed for w in ws), Counter(p for ws in listed for p in zip(ws, ws[1:]))
    k, whole = perplexity.SMOOTHING, sum(one.values()) + perplexity.SMOOTHING * (len(one) + 1)
    total = 0.0
    for w1, w2 in zip(text.split(), text.split()[1:]):
        followers = [c for (x, _), c in two.items() if x == w1]
        p, t, c1 = (one[w2] + k) / whole, len(followers), sum(followers)
        total -= math.log((two[w1, w2] + t * p) / (c1 + t) if t else p)
    return total


def test_stored_costs_are_the_formula(spark, tmp_path):
    perplexity.write_costs(perplexity.fit_costs(spark.createDataFrame([(x,) for x in CORPUS], "text string")), f"{tmp_path}/m")
    costs = perplexity.read_costs(spark, f"{tmp_path}/m")
    texts = ["a b c d", "x y", "e zz a b a b", "c a", "one", "", None, "f f f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.nll for r in perplexity.stored_perplexities(rows, "doc_id", costs).collect()}
    assert got.keys() == {n for n, x in enumerate(texts) if x and len(x.split()) > 1}
    assert all(v == pytest.approx(plain_nll(texts[n])) for n, v in got.items())
    # after each first word, the chances of all words, unseen ones together as one, add up to 1
    words = sorted({w for x in CORPUS if x for w in x.split()}) + ["unseen"]
    for first in ("a", "c", "f"):
        pairs = spark.createDataFrame([(n, f"{first} {w}") for n, w in enumerate(words)], "doc_id bigint, text string")
        assert sum(math.exp(-r.nll) for r in perplexity.stored_perplexities(pairs, "doc_id", costs).collect()) == pytest.approx(1)


def test_model_of_an_empty_corpus(spark):
    costs = perplexity.fit_costs(spark.createDataFrame([], "text string"))
    assert [(r.kind, r.cost) for r in costs.collect()] == [("unseen", 0)]
    rows = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert [r.word_ppl for r in perplexity.stored_perplexities(rows, "doc_id", costs).collect()] == [1]
    assert perplexity.stored_perplexities(rows.limit(0), "doc_id", costs).count() == 0


def test_router_is_measured_on_rows_it_has_not_seen(spark, tmp_path):
    side = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    rows = spark.range(400).select(
        "id", F.array(side, F.sin("id")).alias("v"), F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id") % 2).cast("int").alias("label")
    )
    model = routing.fit_router(rows.filter(~routing.held_out(F.col("id"), 7)), "v")
    routing.save_router(model, f"{tmp_path}/r")
    again = routing.load_router(f"{tmp_path}/r")
    paths = [sorted(map(tuple, routing.route(rows, "id", "v", m, ["x", "y"]).collect())) for m in (model, again)]
    assert paths[0] == paths[1]
    chosen = {r.id: r.route for r in routing.route(rows, "id", "v", model, ["x", "y"]).collect()}
    flagged = rows.select("id", "label", routing.held_out(F.col("id"), 7).alias("out")).collect()
    want = {}
    for name, out in (("held_out", True), ("fitted", False)):
        part = [r for r in flagged if r.out == out]
        want[name] = (len(part), pytest.approx(sum(chosen[r.id] == r.label for r in part) / len(part)))
    got = {r.run_id: (r.n, r.accuracy) for r in routing.accuracy_rows(rows, "v", again, 7, "id").collect()}
    assert got == want and 40 < got["held_out"][0] < 120


def test_one_load_per_worker_in_order_and_nulls(spark, tmp_path):
    log = f"{tmp_path}/loads"

    def load():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda system, user: [f"{len(s) > 0}:{u}" for s, u in zip(system, user)]

    answer = judge.batch_answerer(load, "order test")
    asked = spark.range(1000).repartition(16).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("p"))
    for _ in range(2):
        got = {r.id: r.a for r in asked.select("id", answer(F.col("p")).alias("a")).collect()}
        assert got == {n: f"True:{n}" if n % 7 else None for n in range(1000)}
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) > 0
    nothing = spark.createDataFrame([(None,), (None,)], "p string").coalesce(1)
    assert [r.a for r in nothing.select(answer(F.col("p")).alias("a")).collect()] == [None, None]


def test_wrong_number_of_results_is_an_error(spark):
    short = batches.column(lambda: lambda x: x[1:], "string")
    with pytest.raises(Exception, match="results for"):
        spark.range(3).select(short(F.col("id").cast("string"))).collect()


def test_held_models_are_bounded():
    for n in range(10):
        batches.held(f"m{n}", lambda: object())
    assert len(sys.modules[batches._STATE].models) == batches.HELD_AT_MOST


def test_batch_embedder(spark):
    embed = batches.column(lambda: lambda x: [[float(len(w)), 1.0] for w in x], "array<double>")
    rows = spark.createDataFrame([("a bc",), (None,)], "t string").select(embed(F.col("t")).alias("v"))
    assert [r.v for r in rows.collect()] == [[4.0, 1.0], None]


def metric(rows, name):
    return {r.idx: r.text if r.text else r.value for r in rows if r.metric == name}


def test_reading_suite(spark):
    answers = {"Where?": "In Rome.", "Who?": "Nobody", "When?": ""}

    def look_up(prompt, preset):
        question = F.substring_index(F.substring_index(prompt, "##QUESTION: ", -1), "\n\n##CONTEXT", 1)
        known = F.create_map(*[F.lit(x) for kv in answers.items() for x in kv])
        assert preset == g.LONG_EVALUATION
        return F.array(F.concat(F.lit("<s>"), F.get(F.array(known[question]), 0)))

    rows = [(1, "Where?", "c", ["Rome", "in rome"]), (2, "Who?", "c", ["Caesar"]), (3, "When?", "", [])]
    asked = spark.createDataFrame(rows, "idx bigint, question string, context string, answers array<string>")
    got = suites.reading_run(asked, g.Model(look_up, special_tokens=("<s>",))).collect()
    assert metric(got, "squad_exact_match") == {None: pytest.approx(100 / 3)}
    assert metric(got, "squad_f1") == {None: pytest.approx(100 / 3)}
    assert metric(got, "squad_oracle_acc_text") == {1: "YES", 2: "NO", 3: "NO"}
    assert metric(got, "squad_oracle_acc") == {1: 1.0, 2: 0.0, 3: 0.0}


def test_instruction_and_sentiment_suites(spark):
    rows = spark.createDataFrame(
        [("r", 1, "Say hello", "", "Say hello..."), ("r", 2, "Add", "1 and 2", "3")], "run_id string, idx bigint, instruction string, input string, reference string"
    )
    got = suites.instruction_run(rows, g.BASELINE).collect()
    assert metric(got, "benchmark_oracle_acc") == {1: 1.0, 2: 0.0}
    assert 0 < metric(got, "benchmark_rouge1")[None] < 1 and metric(got, "benchmark_bleu")[None] > 0
    # the echo repeats the prompt, which names POSITIVE: label 1 every time
    labels = spark.createDataFrame([("Fine.", 1), ("Bad.", 0), ("Good.", 1), (None, 0)], "sentence string, label int")
    assert [r.value for r in suites.sentiment_run(labels, g.BASELINE).collect()] == [0.75]
