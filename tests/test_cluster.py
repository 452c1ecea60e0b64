"""Density clustering against a plain dendrogram build, and the two ways against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askance.operators import cluster


def brute(vectors, copies, size=5, k=5):
    """Leaf clusters by the book: expand copies, full linkage tree, condense, take leaves."""
    x = np.repeat(np.asarray(vectors, dtype=float), copies, axis=0)
    owner = np.repeat(np.arange(len(vectors)), copies)
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(k, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    node_of = {i: i for i in range(n)}
    members = {i: [i] for i in range(n)}
    kids, height = {}, {}
    nxt = n
    for w, i, j in edges:
        a, b = node_of[i], node_of[j]
        if a == b:
            continue
        kids[nxt], height[nxt], members[nxt] = (a, b), w, members[a] + members[b]
        for m in members[nxt]:
            node_of[m] = nxt
        nxt += 1
    root = nxt - 1
    # condense: (parent cluster, child, weight, is cluster)
    rows, todo, count = [], [(root, 0)], 1
    while todo:
        node, name = todo.pop()
        if node not in kids:
            continue
        a, b = kids[node]
        big = [c for c in (a, b) if len(members[c]) >= size]
        if len(big) == 2:
            for c in (a, b):
                rows.append((name, ("cluster", count), height[node]))
                todo.append((c, count))
                count += 1
        else:
            for c in (a, b):
                if c in big:
                    todo.append((c, name))
                else:
                    rows += [(name, ("point", m), height[node]) for m in members[c]]
    parents = {p for p, (kind, _), _ in rows if kind == "cluster"}
    names = {c for _, (kind, c), _ in rows if kind == "cluster"}
    leaves = names - parents
    label = [-1] * n
    if leaves:
        for p, (kind, m), _ in rows:
            if kind == "point" and p in leaves:
                label[m] = p
    else:
        low = min(w for _, _, w in rows)
        for _, (_, m), w in rows:
            label[m] = 0 if w == low else -1
    out = {}
    for o, lab in zip(owner, label):
        out.setdefault(int(o), set()).add(lab)
    assert all(len(v) == 1 for v in out.values())
    return [out[i].pop() for i in range(len(vectors))]


def same_up_to_names(a, b):
    if [x is None or x == -1 for x in a] != [x is None or x == -1 for x in b]:
        return False
    pairs = {(x, y) for x, y in zip(a, b) if not (x is None or x == -1)}
    return len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})


def cases():
    rng = np.random.default_rng(7)
    blobs = np.concatenate([rng.normal(c, 0.3, (12, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 6, 6))] + [rng.uniform(-4, 9, (9, 3))])
    yield "blobs", blobs, np.ones(len(blobs), dtype=int)
    yield "noise", rng.normal(size=(40, 4)), np.ones(40, dtype=int)
    yield "copies", rng.normal(size=(25, 3)), rng.choice([1, 2, 3, 6, 7, 8], 25)
    yield "one group", np.concatenate([rng.normal(0, 0.05, (6, 2)), rng.uniform(3, 30, (7, 2)) * [[1, 3]]]), np.ones(13, dtype=int)


def as_rows(vectors, copies, run="r"):
    return [(run, f"p{i:03d}", int(c), [float(x) for x in v]) for i, (v, c) in enumerate(zip(vectors, copies))]


SCHEMA = "run_id string, pid string, copies bigint, vector array<double>"


@pytest.mark.parametrize("name,vectors,copies", list(cases()), ids=[c[0] for c in cases()])
def test_labels_in_one_task(spark, name, vectors, copies):
    want = brute(vectors, copies)
    got = cluster.labels(spark.createDataFrame(as_rows(vectors, copies), SCHEMA)).orderBy("pid").collect()
    assert same_up_to_names([r["cluster"] for r in got], want)


def test_block_way_equals_one_task(spark):
    rows = [r for name, v, c in cases() for r in as_rows(v, c, name)]
    points = spark.createDataFrame(rows, SCHEMA)
    one = {(r["run_id"], r["pid"]): r["cluster"] for r in cluster.labels(points).collect()}
    many = {(r["run_id"], r["pid"]): r["cluster"] for r in cluster.labels(points, block=9).collect()}
    assert one.keys() == many.keys()
    for name in {k[0] for k in one}:
        keys = sorted(k for k in one if k[0] == name)
        assert same_up_to_names([one[k] for k in keys], [many[k] for k in keys]), name


def test_counts(spark):
    rows = [("r", f"p{i}", 2, c) for i, c in enumerate(["p0", "p0", "p2", None, None])]
    out = cluster.cluster_counts(spark.createDataFrame(rows, "run_id string, pid string, copies bigint, cluster string")).first()
    assert (out["num_clusters"], out["num_outliers"]) == (2, 4)


@pytest.mark.parametrize("name", ["trending_run", "external_run", "baseline_oracle_run"])
def test_whole_reports_have_all_scores(spark, sf, name):
    from askance.plans.catalog import QUERIES

    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(r["curiosity_score"] is not None and r["self_learning_capability_score"] is not None for r in rows)


def test_report_counts_clusters_by_the_book(spark, sf):
    """Curiosity of the oracle-selected runs against the plain build, question by question."""
    from askance.functions.vectors import hash_embedding
    from askance.plans import queries_vectors, runs

    asked = queries_vectors._oracle_run(spark, sf).select("run_id", "prompt", "hallucinated")
    asked = spark.createDataFrame(asked.collect(), asked.schema)
    got = {r["run_id"]: r for r in runs.full_report(asked).collect()}
    vectors = {}
    for r in asked.select("run_id", "prompt", hash_embedding(F.col("prompt")).alias("v")).collect():
        vectors.setdefault(r["run_id"], []).append((r["prompt"], list(r["v"])))
    clustered = 0
    for run, rows in vectors.items():
        if len({p for p, _ in rows}) <= 10:
            want = len({p for p, _ in rows})
        else:
            clustered += 1
            label = brute([v for _, v in sorted(rows)], np.ones(len(rows), dtype=int))
            want = len(set(label) - {-1}) + label.count(-1)
        assert abs(got[run]["curiosity_score"] - want / len(rows)) < 1e-9
    assert clustered


def test_block_tree_is_the_dense_tree():
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e150, 1e-150):
        for n in (1, 2, 300):
            v = np.round(rng.normal(size=(n, 3)), 1) * scale  # many ties and equal points
            dist = cluster._distances(v, v)
            core = np.sort(dist, axis=1)[:, min(5, n - 1)]
            reach = np.maximum(dist, np.maximum(core[:, None], core[None, :]))
            assert cluster._pair_tree(v, core) == cluster._tree(reach)


def test_rounds_stay_among_the_executors(spark):
    tree = spark.createDataFrame([("r", 1.0, "a", "b"), ("r", 2.0, "b", "c")], "run_id string, w double, u string, v string")
    home = spark.createDataFrame([("r", x, x) for x in "abc"], "run_id string, pid string, comp string")
    ends = cluster._ends(tree, home)
    assert ends.count() == 2
    assert "Broadcast" not in ends._jdf.queryExecution().toString()


def test_few_edges_leave_the_block_pairs_and_the_tree_is_the_dense_one(spark, monkeypatch):
    """Ties, equal points and groups far apart: however many blocks, a few candidates per point, and the same tree."""
    rng = np.random.default_rng(11)
    spread = np.concatenate([np.round(rng.normal(c, 1.0, (120, 2)), 1) for c in (0, 40)] + [rng.normal(90, 4, (60, 2))])
    copies = np.r_[np.ones(290, dtype=int), np.full(10, 3)]
    met = {}

    def spy(points, candidates, tree=cluster.spanning_tree):
        met["edges"], met["tree"] = candidates.count(), tree(points, candidates)
        return met["tree"]

    monkeypatch.setattr(cluster, "spanning_tree", spy)
    points = spark.createDataFrame(as_rows(spread, copies), SCHEMA)
    got = cluster.labels(points, block=12).orderBy("pid").collect()
    assert met["edges"] < 5 * len(spread)
    dist = cluster._distances(spread, spread)
    core = cluster._core(dist, copies, 5)
    want = cluster._tree(np.maximum(dist, np.maximum(core[:, None], core[None, :])))
    assert {(r.w, r.u, r.v) for r in met["tree"].collect()} == {(w, *sorted((a, b))) for w, a, b in want}
    one = cluster.labels(points).orderBy("pid").collect()
    assert same_up_to_names([r.cluster for r in got], [r.cluster for r in one])


def test_pairs_lighter_than_the_first_tree_hold_the_tree(monkeypatch):
    """Also from a poor first tree, a chain or two chains without a link, and when more is found than may be held."""
    import pandas as pd

    v = np.random.default_rng(3).normal(size=(90, 4))
    dist = cluster._distances(v, v)
    core = np.sort(dist, axis=1)[:, 5]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None, :]))
    want = {(w, *sorted((a, b))) for w, a, b in cluster._tree(reach)}
    for held in (1_000_000, 5):
        for name, value in {"_HELD": held, "_ROWS": 4, "_EXACT": 7}.items():
            monkeypatch.setattr(cluster, name, value)
        for cut in (89, 40):
            u = np.array([i for i in range(89) if i != cut])
            first = pd.DataFrame({"run_id": "r", "w": reach[u, u + 1], "u": u, "v": u + 1})
            rows = cluster._merged_order(12)(first)
            rows["core"], rows["vector"] = core[rows["pid"]], list(v[rows["pid"]])
            edges = [first[["w", "u", "v"]].to_numpy()]
            for a in range(8):
                for b in range(a, 8):
                    pair = rows[rows["own"].isin([a, b])].assign(a=a, b=b)
                    for c in ("n", "lw", "lu", "lv"):
                        pair[c] = [x[b if own == a else a] for x, own in zip(pair[c], pair["own"])]
                    edges.append(cluster._lighter(pair)[["w", "u", "v"]].to_numpy())
            tree = cluster._forest(np.concatenate(edges))
            assert {(w, int(x), int(y)) for w, x, y in tree} == want
