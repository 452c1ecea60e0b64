import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askance.operators import overlap, perplexity
from askance.plans import suites

words = st.lists(st.sampled_from("a b c d e".split()), max_size=14)


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


@settings(max_examples=300, deadline=None, database=None)
@given(words, words)
def test_lcs_length(a, b):
    assert overlap.lcs_length(a, b) == lcs_table(a, b)[-1][-1]


@settings(max_examples=300, deadline=None, database=None)
@given(words, words)
def test_lcs_members_form_a_longest_subsequence(gold, pred):
    t = lcs_table(gold, pred)
    i, j, want = len(gold), len(pred), set()
    while i and j:
        if gold[i - 1] == pred[j - 1]:
            want.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    assert overlap.lcs_members(gold, pred) == want


@settings(max_examples=200, deadline=None, database=None)
@given(words, words, st.integers(1, 4))
def test_clipped_hits(a, b, n):
    grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    assert overlap.clipped_hits(a, b, n) == sum((grams(a) & grams(b)).values())


def rows(spark, *pairs):
    return spark.createDataFrame(
        [("r", i, "q", p, g) for i, (p, g) in enumerate(pairs)],
        "run_id string, idx bigint, prompt string, prediction string, reference string",
    )


def test_identical_texts_score_one(spark):
    same = rows(spark, ("The cat sat, on 3.5 mats!", "The cat sat, on 3.5 mats!"), ("a b c d\ne f", "a b c d\ne f"))
    b = overlap.bleu(same).first()
    assert abs(b["bleu"] - 1) < 1e-12 and b["brevity_penalty"] == 1
    for r in overlap.rouge_n(same, ["idx"]).join(overlap.rouge_l(same, ["idx"]), "idx").collect():
        assert [r[c] for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")] == [1.0] * 4


def test_bleu_tokens_and_penalty(spark):
    b = overlap.bleu(rows(spark, ("the cat is here now", "the cat is here now, my friend."))).first()
    # reference tokens: the cat is here now , my friend .
    assert (b["translation_length"], b["reference_length"]) == (5, 9)
    assert abs(b["brevity_penalty"] - math.exp(1 - 9 / 5)) < 1e-12 and b["precision_4"] == 1.0
    assert overlap.bleu(rows(spark, ("x", "y"))).first()["bleu"] == 0.0


def test_rouge_lsum_is_line_by_line(spark):
    r = overlap.rouge_l(rows(spark, ("c d\na b", "a b\nc d")), ["idx"]).first()
    assert (r["rougeL"], r["rougeLsum"]) == (0.5, 1.0)


def test_squad(spark):
    data = spark.createDataFrame(
        [("a", "The Cat.", ["a dog", "cat"]), ("b", "big cat", ["the cat"]), ("c", "x", ["y"]), ("d", "the", ["a"])],
        "id string, prediction string, answers array<string>",
    )
    got = {r["id"]: (r["exact_match"], round(r["f1"], 6)) for r in overlap.squad(data, "id").collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, round(2 / 3, 6)), "c": (0.0, 0.0), "d": (1.0, 0.0)}
    suite = {r["metric"]: r["value"] for r in suites.reading_suite(data.filter("id = 'a'"), "id").collect()}
    assert suite == {"squad_exact_match": 100.0, "squad_f1": 100.0}


def test_sentiment_label_is_case_sensitive(spark):
    data = spark.createDataFrame([("so POSITIVE", 1), ("positive", 1), ("NEGATIVE", 0)], "prediction string, label int")
    assert abs(suites.sentiment_suite(data).first()["value"] - 2 / 3) < 1e-12


def test_perplexity_against_plain_counts(spark):
    random.seed(2)
    texts = [" ".join(random.choice("a b c d".split()) for _ in range(random.randint(0, 9))) for _ in range(20)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    other = spark.createDataFrame([(0, "a b z"), (1, "z q"), (2, "a")], "doc_id bigint, text string")
    pair, first, vocab = Counter(), Counter(), set()
    for t in texts:
        w = t.split()
        vocab |= set(w)
        pair.update(zip(w, w[1:]))
        first.update(w[:-1])
    model = perplexity.fit(corpus)
    k = perplexity.SMOOTHING

    def nll(t):
        w = t.split()
        return sum(-math.log((pair[p] + k) / (first[p[0]] + k * len(vocab))) for p in zip(w, w[1:]))

    for data, kw in ((corpus, {"in_corpus": True}), (corpus, {}), (other, {})):
        source = {r["doc_id"]: r["text"] for r in data.collect()}
        got = {r["doc_id"]: r for r in perplexity.perplexities(data, "doc_id", model, **kw).collect()}
        assert got.keys() == {i for i, t in source.items() if len(t.split()) >= 2}
        for i, r in got.items():
            t = source[i]
            assert abs(r["nll"] - nll(t)) < 1e-9
            assert abs(r["token_ppl"] - math.exp(nll(t) / (len(t.split()) - 1))) < 1e-9
            assert abs(r["char_ppl"] - math.exp(nll(t) / len(t.strip()))) < 1e-9


def test_perplexity_suite_samples_and_cuts(spark):
    data = spark.createDataFrame([(i, "w " * 300 + str(i)) for i in range(30)] + [(99, "x"), (98, None)], "doc_id bigint, text string")
    texts = suites.perplexity_texts(data, sample=20)
    assert texts.count() <= 20 and {len(r["text"].split()) for r in texts.collect()} == {256}
    model = perplexity.fit(data)
    got = {r["metric"]: r["value"] for r in suites.perplexity_suite(data, model, sample=None, word_limit=None).collect()}
    assert got["mean_words"] == 301.0 and set(got) == {f"mean_{c}" for c in ("chars", "words", "nll", "token_ppl", "char_ppl", "word_ppl")}


def test_instruction_suite(spark):
    data = spark.createDataFrame(
        [("r", i, f"say {i}", "" if i % 2 else "loud", f"say {i}...") for i in range(6)],
        "run_id string, idx bigint, instruction string, input string, reference string",
    )
    from askance.operators.generate import BASELINE

    answered = suites.instruction_rows(data, BASELINE, sample=4)
    assert answered.count() == 4
    plain = answered.filter("input = ''").select("prediction", "reference").collect()
    assert all(r["prediction"] == r["reference"] for r in plain)
    metrics = suites.qa_suite(answered, "benchmark", "benchmark_")
    names = {r["metric"] for r in metrics.collect()}
    assert {"benchmark_bleu", "benchmark_rougeLsum", "benchmark_oracle_acc", "benchmark_oracle_acc_text"} <= names
    assert metrics.filter("metric = 'benchmark_oracle_acc'").filter(F.col("idx").isNotNull()).count() == 4


def test_a_batch_is_read_in_parts(spark):
    import tracemalloc

    import pyarrow as pa

    batch = pa.array([[f"token{i}" for i in range(50)]] * 5000 + [None])
    tracemalloc.start()
    rows = [len(a) + len(b) for a, b in overlap._rows(batch, batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [100] * 5000 + [0]
    assert peak < 4_000_000  # all tokens at once take tens of it
    odd = spark.createDataFrame([(1, "a b", None), (2, None, "a b"), (3, "a b", "a b")], "idx bigint, prediction string, reference string")
    assert [r["rougeL"] for r in overlap.rouge_l(odd, ["idx"]).orderBy("idx").collect()] == [0.0, 0.0, 1.0]


def test_own_perplexities_in_small_blocks_and_buckets(spark):
    random.seed(3)
    texts = [" a  b\x1ca\n", " a", "", None, "\x85", *(" ".join(random.choice("a b c d é".split()) for _ in range(random.randint(0, 9))) for _ in range(40))]
    # equal keys are texts of their own, and a text without a key counts but is not shown
    named = [(f"k{min(i, 40)}" if i != 7 else None, t) for i, t in enumerate(texts)]
    data = spark.createDataFrame(named, "name string, text string").repartition(3)
    words = [(t or "").split() for t in texts]
    pair = Counter(p for w in words for p in zip(w, w[1:]))
    first, vocab, k = Counter(x for w in words for x in w[:-1]), len({x for w in words for x in w}), perplexity.SMOOTHING
    want = sorted(
        (name, len(t.strip()), len(w), round(sum(-math.log((pair[p] + k) / (first[p[0]] + k * vocab)) for p in zip(w, w[1:])), 9))
        for (name, t), w in zip(named, words) if name and len(w) > 1
    )
    for limits in ({}, {"block_words": 5, "bucket_pairs": 3}):
        out = perplexity.own_perplexities(data, "name", **limits)
        assert sorted((r["name"], r["chars"], r["words"], round(r["nll"], 9)) for r in out.collect()) == want
    assert perplexity.own_perplexities(data.filter("text = ''"), "name").count() == 0


def test_perplexity_rows_move_no_row_per_word(spark, tmp_path):
    from askance.plans.catalog import QUERIES

    spark.createDataFrame([(i, "a b a b " * 50) for i in range(9)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["perplexity_rows"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert {(r["doc_id"], r["words"]) for r in out.collect()} == {(i, 200) for i in range(9)}


def test_the_walk_back_meets_only_shared_tokens():
    class Token(str):
        met = 0
        __hash__ = str.__hash__

        def __eq__(self, other):
            Token.met += 1
            return str.__eq__(self, other)

    gold = [Token(f"g{i}") for i in range(2000)]
    gold[500], gold[1500] = Token("x"), Token("y")
    assert overlap.lcs_members(gold, ["x", "q", "y"]) == {500, 1500}
    assert Token.met < 100  # one a gold token before
    random.seed(4)
    for _ in range(300):
        g, p = ([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2))
        members = sorted(overlap.lcs_members(g, p))
        rest = iter(p)
        assert len(members) == overlap.lcs_length(g, p) and all(g[i] in rest for i in members)


def test_hits_of_a_batch_are_those_of_its_rows(spark):
    import pyarrow as pa

    random.seed(5)
    for _ in range(50):
        p, g = ([random.choice([None, [random.choice("ab") for _ in range(random.randint(0, 7))]]) for _ in range(6)] for _ in range(2))
        got = overlap.batch_hits(pa.array(p, pa.list_(pa.string())), pa.array(g, pa.list_(pa.string())), 4)
        assert got.tolist() == [[overlap.clipped_hits(a or [], b or [], n) for n in range(1, 5)] for a, b in zip(p, g)]
    rows = spark.createDataFrame([(1, "a b", "a b"), (2, None, "a"), (3, "a b c", "c a b")], "idx bigint, prediction string, reference string")
    wide = {r["idx"]: r.asDict() for r in overlap.rouge(rows, ["idx"]).collect()}
    for part in (overlap.rouge_n(rows, ["idx"]), overlap.rouge_l(rows, ["idx"])):
        for r in part.collect():
            assert r.asDict().items() <= wide[r["idx"]].items()
