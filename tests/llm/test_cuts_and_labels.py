"""Centroids, toxicity and fill-in-middle against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest_odd import ODD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askance.llm import ann, centroids, fim, pieces, toxicity, warc

VECTORS = "vec_id bigint, embedding array<double>, label int, x int, dots string, cluster string"


# ---- 11: centroids --------------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3):
    """Everything anew in each round, in Python integers; (vec_id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(64 * v) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    starts = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(x) for _, x in starts[:k]]

    def assign():
        out = []
        for i, x in kept:
            d, n = min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cents))
            out.append((i, n, d))
        return out

    for _ in range(rounds):
        found = assign()
        for n in range(len(cents)):
            mine = [x for (_, x), (_, m, _) in zip(kept, found) if m == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine)]
    return assign(), cents


def checked(spark, rows):
    frame = spark.createDataFrame([(i, e, 0, 1, "d", "c") for i, e in rows], VECTORS).repartition(3)
    got = centroids.report(centroids.cluster(frame)).collect()
    want, cents = plain_clusters(rows)
    key = lambda t: tuple((v is None, v) for v in t)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    per = {}
    for _, n, d in want:
        per[n] = per.get(n, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    for r in got:
        assert (r.cluster_inertia, r.inertia, r.centroid_sha256) == (per[r.cluster], sum(per.values()), digests[r.cluster])
    return got


def test_centroids_are_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(n, (rng.normal(size=64) * (1 + n % 3)).tolist()) for n in range(150)]
    rows += [(n + 500, rows[5][1]) for n in range(40)]  # copies: ties between centroids that are alike
    rows += [rows[7], rows[7], (None, rows[9][1]), (900, [0.0] * 64), (901, [-0.0] * 64), (2**53 + 1, rows[1][1]), (2**53 + 3, rows[2][1])]
    rows += [(902, None), (903, [1.0] * 63), (904, [1.0] * 65), (905, [None] + [1.0] * 63), (906, [float("nan")] * 64), (907, [float("inf")] * 64), (908, [])]
    got = checked(spark, rows)
    assert {902, 903, 904, 905, 906, 907, 908}.isdisjoint({r.vec_id for r in got})


def test_centroids_of_few_or_no_vectors(spark):
    checked(spark, [(1, [0.5] * 64), (2, [0.5] * 64), (3, [2.0] * 64)])
    none = spark.createDataFrame([(1, None, 0, 1, "", "")], VECTORS)
    found = centroids.report(centroids.cluster(none))
    assert found.count() == 0 and found.schema["distance"].dataType.simpleString() == "bigint"
    # beyond what an exact 64-bit distance can hold
    assert centroids.report(centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 0, 1, "", "")], VECTORS))).count() == 0


def test_stored_products_stay_exact(spark, sf):
    found = centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))
    for r in found.rows.collect():
        assert r.dots == (found.centroids @ np.array(r.x)).tolist()


# ---- 12: toxicity ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(documents, spark, sf):
    return toxicity.learn(documents, spark.read.parquet(f"{sf}/labels.parquet"))


def plain_score(model, text):
    clean = 1.0
    for sentence in re.findall(r"[^.!?\n]*[^.!?\s][^.!?\n]*", text or ""):
        z = model.bias
        for word in {w.lower() for w in re.findall(r"[^\W\d_]+", sentence)}:
            marks = {f"w{word}"} | {f"{n}{word[:n]}" for n in (3, 4, 5) if len(word) >= n}
            z += sum(model.weights.get(b, 0.0) for b in {zlib.crc32(m.encode()) % toxicity.BUCKETS for m in marks})
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_are_noisy_or_of_sentences(documents, odd, spark, sf, model):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for frame in (documents, odd.filter(F.length("text") < 100)):
        texts = [r.text for r in frame.collect()]
        got = frame.select("text", toxicity.scored(F.col("text"), model).alias("s")).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.s.score == pytest.approx(plain_score(model, r.text), abs=1e-9)
            for o in r.s.offending:
                assert plain_score(model, r.text[o.start : o.end]) == pytest.approx(o.score, abs=1e-9) and o.score >= 0.5
    assert labels.count() > 0


def bag(spark):
    """Texts of neutral words; toxic ones have a vile word in one sentence."""
    rng = np.random.default_rng(5)
    common = ["stone", "river", "cloud", "table", "green", "walks", "under", "seven", "paper", "music"]
    vile = ["grobnik", "zutterfang", "plimwort"]
    docs, labels, where = [], [], {}
    for n in range(600):
        sentences = [" ".join(rng.choice(common, 8)) for _ in range(int(rng.integers(1, 12)))]
        toxic = int(n % 5 == 0 or n % 7 == 0)
        if toxic:
            at = int(rng.integers(len(sentences)))
            sentences[at] += " " + vile[n % 3]
            where[n] = ". ".join(sentences[:at]) and len(". ".join(sentences[:at])) + 1
        docs.append((n, ". ".join(sentences) + ".", "k"))
        labels.append((n, toxic, "x"))
    labels += [(None, 1, "x"), (3, None, "x"), (4, 9, "x"), labels[8]]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, toxic string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int, text string"), where, docs,
    )


def test_held_out_documents_and_sentences(spark):
    docs, labels, where, rows = bag(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) == int(r.doc_id in where)
        text = rows[r.doc_id][1]
        for o in r.offending:
            assert any(v in text[o.start : o.end] for v in ("grobnik", "zutterfang", "plimwort"))
        assert len(r.offending) == int(r.doc_id in where)


def test_odd_rows_and_no_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.toxicity(odd, none).collect()
    assert len(got) == odd.count() and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    assert {r.score for r in got if r.doc_id in (0, 1, 2)} == {0.0}
    assert toxicity.toxicity(empty, none).count() == 0
    one = spark.createDataFrame([(5, 1)], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.toxicity(odd, one).collect()} == {0}


def test_held_out_labels_teach_nothing(spark):
    docs, labels, _, _ = bag(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, turned) == toxicity.learn(docs, labels)


# ---- 13: fill in the middle -----------------------------------------------------------------


def plain_cut(doc_id, text):
    t, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in fim.MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return doc_id, n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_cuts_are_brute_force(spark, documents, odd):
    marked = spark.createDataFrame([(n, t) for n, t in enumerate(["a<P>b", "<S>", "x<M", "<<S", "<P", "é<", "<<<<", None])] * 40, "doc_id bigint, text string")
    more = marked.withColumn("doc_id", F.col("doc_id") + 8 * F.monotonically_increasing_id())
    for frame in (documents, odd, more):
        rows = frame.select("doc_id", "text").collect()
        got = fim.digests(frame).collect()
        want = [(*cut[:5], sha(cut[5]), sha(r.text or "")) for r in rows for cut in [plain_cut(r.doc_id, r.text)]]
        key = lambda t: tuple((v is None, v) for v in t)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_words_and_lines_come_back(spark, documents):
    texts = documents.select("doc_id", F.concat(F.lit(" \n"), "text").alias("text"))
    for unit, parts in (("word", r"\s*\S+\s*|\s+"), ("line", r"[^\n]*\n|[^\n]+")):
        whole = {r.doc_id: r.text for r in texts.collect()}
        for r in fim.fill_in_middle(texts, unit).collect():
            text = whole[r.doc_id]
            pieces = re.findall(r"\s*[^ \t\n\v\f\r]+\s*" if unit == "word" else parts, text)
            if "".join(pieces) == text:
                assert r.n == len(pieces)
            if r.form == "psm":
                assert r.output.split("<S>")[0] == "<P>" + "".join(pieces[: r.prefix_chars])
        assert fim.fill_in_middle(texts, unit).filter(fim.restored(F.col("output"), F.col("form")) != F.col("output")).count() > 0
        back = fim.fill_in_middle(texts, unit).join(texts, "doc_id")
        assert back.filter(fim.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(documents, "page")


def test_empty_table(empty):
    assert fim.digests(empty).count() == 0
    assert fim.rank_index(empty).count() == 0


def test_stored_index_gives_every_boundary(spark, odd):
    for r in fim.rank_index(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        data = (r.text or "").encode()
        want = np.cumsum([0] + [len(c.encode()) for c in r.text or ""])
        index = fim.RankIndex(
            np.array([s.rank for s in r.segments]), np.array([s.offset for s in r.segments]),
            np.array([s.slope for s in r.segments]), np.frombuffer(r.residuals, dtype=np.int8),
        )
        assert r.n_units == len(want) - 1 and index.offset(np.arange(len(want))).tolist() == want.tolist()
        assert want[-1] == len(data)
        if all(ord(c) < 128 for c in r.text or ""):
            assert len(r.segments) == 1 and not any(r.residuals)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5_000), max_size=400), st.sampled_from([0, 3, 120]))
def test_segments_keep_the_error_bound(gaps, bound):
    offsets = np.cumsum([0, *gaps]).astype(np.int64)
    made = fim.fit(offsets, bound)
    assert np.abs(made.residuals.astype(int)).max() <= bound + 1
    assert made.offset(np.arange(len(offsets))).tolist() == offsets.tolist()


def test_long_texts_of_mixed_widths():
    text = ("plain words " * 3_000 + "中文文字😀" * 3_000) * 3
    ends = fim.boundaries(np.frombuffer(text.encode(), dtype=np.uint8))
    made = fim.fit(ends)
    assert 3 < len(made.ranks) < 40 and made.offset(np.arange(len(ends))).tolist() == ends.tolist()
    assert ODD_TEXTS


# ---- ids and batches of the older operators -------------------------------------------------


def test_archived_ids_stay_whole_beside_nulls(spark):
    """Page ids that no double holds, with and without a null id among them."""
    big, kind = 2**53, "page_id bigint, url string, html string"
    rows = [(big + 1, "u", "same"), (big + 3, "u", "same"), (big + 5, "u", "other")]
    for more in ([], [(None, "u", "third"), (None, None, None)]):
        got = warc.archived(spark.createDataFrame(rows + more, kind).coalesce(1)).collect()
        assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id} == {
            (big + 1, "revisit", big + 3), (big + 3, "response", None), (big + 5, "response", None),
        }
        assert len(got) == len(rows + more) and sum(r.page_id is None for r in got) == len(more)


def test_pieces_do_not_depend_on_neighbours(spark, pieces_path):
    texts = ["First line\n\n  then two blanks.", "\x1f\x1e\x1d\x1c", "a\x1fb  c\n\nd.", " x", "plain words, plain end."]
    kind = "doc_id bigint, text string"
    rows = list(enumerate(texts))
    whole = {r.doc_id: r for r in pieces.sampled_digests(spark.createDataFrame(rows, kind).coalesce(1), pieces_path).collect()}
    for row in rows:
        assert pieces.sampled_digests(spark.createDataFrame([row], kind), pieces_path).first() == whole[row[0]]
    spread = pieces.sampled_digests(spark.createDataFrame(rows[::-1], kind).repartition(5), pieces_path).collect()
    assert {r.doc_id: r for r in spread} == whole


def test_tests_follow_the_law_of_the_rotated_share():
    """The quantile against shares of random directions, and that a raised bound abandons more at little loss."""
    rng = np.random.default_rng(2)
    for part, whole in ((16, 64), (48, 64), (1, 3), (64, 64)):
        squares = rng.normal(size=(200_000, whole)) ** 2
        share = squares[:, :part].sum(axis=1) / squares.sum(axis=1)
        assert (share > ann.share_quantile(part, whole, 0.05)).mean() == pytest.approx(0.05 if part < whole else 0.0, abs=0.004)
    x = rng.normal(size=(4_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, q, rotation = np.arange(4_000), x[:50], ann._rotation(64)
    scores = q @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    best = np.sort(scores, axis=1)[:, -20]
    passed = []
    for bound in (np.full(50, -np.inf), np.sort(scores[:, ::8], axis=1)[:, -20], best):
        (who, found, _), pairs, through = ann._scan(ids, x, ids[:50], q, bound, rotation, 20, ann.REJECTED, 16)
        assert pairs == 50 * 4_000
        passed.append(through / pairs)
        hits = sum(scores[a, b] >= best[a] for a, b in zip(who, found))
        assert hits / (50 * 20) > 0.93
    assert passed[0] > passed[1] > passed[2] and passed[1] < 0.5 and passed[2] < 0.3
