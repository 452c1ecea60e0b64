"""The cell join against plain distances, and how much of the work cells save."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askance.operators import cells, neighbours

POINTS, TERMS = "q_id bigint, vector array<double>", "term_id bigint, embedding array<double>"


def plain(points, terms, k):
    out = {}
    for q, v in points:
        near = sorted((float(np.sqrt(((np.array(e) - np.array(v)) ** 2).sum())), t) for t, e in terms)[:k]
        for rank, (d, t) in enumerate(near, 1):
            out[q, rank] = (t, round(d, 9))
    return out


def joined(spark, points, terms, k, block):
    found = cells.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(terms, TERMS), k, block)
    return {(r.q_id, r.rank): (r.term_id, round(r.distance, 9)) for r in found.rows.collect()}, found


def clustered(n, groups, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 10
    return [(int(i), (centres[i % groups] + rng.normal(size=dims) * 0.1).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,block", [(1, 16), (10, 64), (40, 8)])
def test_clustered_vectors_meet_few_pairs(spark, k, block):
    terms = clustered(600, 12, 8, 1)
    points = [(10_000 + i, v) for i, v in clustered(60, 12, 8, 2)]
    got, found = joined(spark, points, terms, k, block)
    assert got == plain(points, terms, k)
    work = found.work.first()
    assert (work.queries, work.terms) == (60, 600)
    assert work.pairs >= 60 * k and work.share < (0.35 if k < 40 else 0.5)


def test_many_copies_are_one_point(spark):
    """A third of all terms are equal: they fill no ring, and the smallest ids among them win."""
    terms = clustered(120, 3, 4, 3)
    terms += [(1_000 + i, terms[7][1]) for i in range(60)] + [(2_000, [0.0] * 4), (2_001, [-0.0] * 4)]
    points = [(1, terms[7][1]), (2, terms[3][1]), (3, [100.0] * 4), (2**53 + 1, [0.0] * 4)]
    got, found = joined(spark, points, terms, 10, 8)
    assert got == plain(points, terms, 10)
    assert found.work.first().terms <= 122


def test_without_clusters_still_exact(spark):
    rng = np.random.default_rng(5)
    terms = [(i, rng.normal(size=32).tolist()) for i in range(300)]
    got, found = joined(spark, terms[:40], terms, 10, 16)
    assert got == plain(terms[:40], terms, 10)
    assert 0 < found.work.first().share <= 1


def test_few_or_no_terms(spark):
    points = [(1, [0.0, 1.0]), (2, None), (None, [1.0, 1.0])]
    got, _ = joined(spark, points, [(5, [0.0, 0.0]), (6, None), (None, [3.0, 4.0]), (7, [3.0, 1.0])], 10, 4)
    assert got == {(1, 1): (5, 1.0), (1, 2): (7, 3.0)}
    got, found = joined(spark, points, [(6, None)], 10, 4)
    assert got == {} and found.work.first().pairs == 0
    none = spark.createDataFrame([], POINTS)
    assert cells.nearest(none, spark.createDataFrame([(5, [0.0, 0.0])], TERMS), 3).rows.count() == 0


def test_queries_of_one_block_are_sharded(spark, monkeypatch):
    monkeypatch.setattr(cells, "SHARD", 7)
    terms = clustered(200, 2, 4, 8)
    points = [(i, v) for i, v in clustered(90, 2, 4, 9)]
    got, _ = joined(spark, points, terms, 5, 32)
    assert got == plain(points, terms, 5)


def test_many_queries_of_open_blocks_meet_them_together(spark, monkeypatch):
    """Without clusters every query goes to nearly every block: once per part, and no term is found twice."""
    dealt = []

    def seen(points, layout, k, later, shards=None, whole=False, deal=cells._dealt):
        dealt.append((whole, len(layout.sizes())))
        return deal(points, layout, k, later, shards, whole)

    for name, value in {"SHARD": 64, "BLOCK": 64, "SIDES": 3, "_dealt": seen}.items():
        monkeypatch.setattr(cells, name, value)
    terms = [(i, np.random.default_rng(i).normal(size=32).tolist()) for i in range(300)]
    terms += [(300 + i, terms[i][1]) for i in range(20)]
    got, found = joined(spark, terms, terms, 10, 16)
    assert got == plain(terms, terms, 10)
    assert dealt[-1][0] and dealt[-1][1] <= 6 < dealt[0][1]
    assert 0 < found.work.first().share <= 1.5


def test_same_rows_as_the_block_join(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector"))
    terms = rows.select(F.col("q_id").alias("term_id"), F.col("vector").alias("embedding"))
    want = {(r.q_id, r.rank): r.term_id for r in neighbours.nearest(rows, terms).collect()}
    assert {(r.q_id, r.rank): r.term_id for r in cells.nearest(rows, terms, block=32).rows.collect()} == want
