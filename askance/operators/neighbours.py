"""Exact nearest-neighbour joins and topic picking.

Distances are worked out block against block inside tasks and only each query's k best leave a
task, so the number of rows made is k per query and block, never one per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let
from ..functions.vectors import l1_normalize

_OUT = "q_id bigint, term_id bigint, distance double"
#: Rows of a block at most. Smaller tables make ``SIDES`` blocks, so up to that many rows a row's copies do not grow with the table.
BLOCK = 32_768
SIDES = 8
_LEAST = 256
_QUERIES, _PROBED, _EXACT = 256, 4_096, 65_536


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _first_copies(t: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that are among the first ``k`` of their equals: no other can be one of a query's k nearest."""
    whole = np.ascontiguousarray(t).view(np.dtype((np.void, t.dtype.itemsize * t.shape[1]))).ravel()
    _, group = np.unique(whole, return_inverse=True)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
    copy = np.arange(len(t)) - np.repeat(starts, np.diff(np.r_[starts, len(t)]))
    return np.sort(order[copy < k])


def block_best(q: np.ndarray, t_ids: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), each queries x min(k, rows): the nearest rows of one block, ties by id.

    Single precision lists what may be among the k nearest: all rows not farther than the k-th of a part of the
    block, with twice the error that single precision can make. Double precision then decides.
    """
    keep = min(k, len(t_ids))
    order = np.argsort(t_ids, kind="stable")
    order = order[_first_copies(t[order], k)] if t.shape[1] else order
    t_ids, t = t_ids[order], t[order]
    with np.errstate(all="ignore"):
        scale = max(np.abs(x).max(initial=0.0, where=np.isfinite(x)) for x in (q, t)) or 1.0
        small = np.ascontiguousarray((t / scale).T, dtype=np.float32)
        t_sq = np.where(np.isfinite(t).all(axis=1), np.einsum("ji,ji->i", small, small), np.float32(np.nan))
        reach = float(np.sqrt(t_sq.max(initial=0.0, where=~np.isnan(t_sq))))
    error = (t.shape[1] + 16) * float(np.finfo(np.float32).eps)
    ids, dists = np.empty((len(q), keep), t_ids.dtype), np.empty((len(q), keep))
    for lo in range(0, len(q), _QUERIES):
        part = q[lo : lo + _QUERIES]
        with np.errstate(all="ignore"):
            rough = ((part / scale) * -2.0).astype(np.float32)
            length = np.sqrt(np.einsum("ij,ij->i", rough, rough)) / 2
            rough = rough @ small
            rough += t_sq
            limit = np.partition(rough[:, :_PROBED], keep - 1, axis=1)[:, keep - 1] if keep <= min(_PROBED, len(t)) else np.full(len(part), np.inf)
            limit = (limit + 2 * error * (length + reach) ** 2).astype(np.float32)
        # Not "nearer than": what is not a number must stay, and comes last.
        at, near = np.divmod(np.flatnonzero(~(rough > limit[:, None])), len(t))
        exact = np.empty(len(at))
        for i in range(0, len(at), _EXACT):
            exact[i : i + _EXACT] = ((t[near[i : i + _EXACT]] - part[at[i : i + _EXACT]]) ** 2).sum(axis=1)
        best = np.lexsort((near, exact, at))
        starts = np.searchsorted(at[best], np.arange(len(part)))
        best = best[starts[:, None] + np.arange(keep)]
        ids[lo : lo + _QUERIES] = t_ids[near[best]]
        dists[lo : lo + _QUERIES] = np.sqrt(exact[best])
    return ids, dists


def _rows(q_ids: np.ndarray, ids: np.ndarray, dists: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"q_id": np.repeat(q_ids, ids.shape[1]), "term_id": ids.ravel(), "distance": dists.ravel()})


def nearest(points: DataFrame, vocab: DataFrame, k: int = fixed.NEAREST_TERMS, block: int = BLOCK) -> DataFrame:
    """(q_id, term_id, distance, rank): the k nearest terms by Euclidean distance, ties by id.

    ``points``: q_id, vector. ``vocab``: term_id, embedding. Both sides are cut into blocks by hash and each block
    pair is one group, at every size of either side: ``SIDES`` blocks, or more so that none is much over ``block`` rows.
    """
    found = _by_blocks(points, vocab, k, block)
    window = Window.partitionBy("q_id").orderBy("distance", "term_id")
    return found.withColumn("rank", F.row_number().over(window).cast("int")).filter(F.col("rank") <= k)


def _sides(rows: int, block: int) -> int:
    return max(1, -(-rows // block), min(SIDES, -(-rows // _LEAST)))


def _by_blocks(points: DataFrame, vocab: DataFrame, k: int, block: int) -> DataFrame:
    n_q, n_t = _sides(points.count(), block), _sides(vocab.count(), block)
    left = points.select(
        "q_id", "vector", F.pmod(F.xxhash64("q_id"), F.lit(n_q)).alias("a"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_t - 1).cast("bigint"))).alias("b"),
    )
    right = vocab.select(
        "term_id", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("a"),
        F.pmod(F.xxhash64("term_id"), F.lit(n_t)).alias("b"),
    )

    def scan(key, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"q_id": [], "term_id": [], "distance": []}).astype(
                {"q_id": "int64", "term_id": "int64", "distance": "float64"}
            )
        found = block_best(_matrix(q["vector"]), t["term_id"].to_numpy(), _matrix(t["embedding"]), k)
        return _rows(q["q_id"].to_numpy(), *found)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(scan, _OUT)


def pick_topics(near: DataFrame, vocab: DataFrame, seed: int, pick: int = fixed.PICKED_TERMS) -> DataFrame:
    """(q_id, topics): ``pick`` of each point's nearest terms in seeded order, names joined.

    The draw ranks (point, term) by md5, so it does not depend on partitioning.
    """
    draw = F.md5(F.concat(F.col("q_id").cast("string"), F.lit(":"), F.col("term_id").cast("string"), F.lit(f":{seed}")))
    window = Window.partitionBy("q_id").orderBy("draw")
    drawn = near.withColumn("draw", draw).withColumn("n", F.row_number().over(window)).filter(F.col("n") <= pick)
    name = F.replace(F.substring_index("term", fixed.TERM_MARK, 1), F.lit("_"), F.lit(" "))
    named = drawn.join(vocab.select("term_id", name.alias("name")), "term_id")
    return named.groupBy("q_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda s: s["name"]), ", ").alias("topics")
    )


def random_points(ids: DataFrame, dims: int, seed: int, key: str = "q_id") -> DataFrame:
    """(key, vector): normal draws per id, L1-normalised; fixed by (seed, id, coordinate)."""

    def uniform(j: Column, tag: str) -> Column:
        h = F.md5(F.concat_ws(":", F.col(key).cast("string"), j.cast("string"), F.lit(f"{seed}{tag}")))
        return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 1) / float(2**48 + 1)

    def normal(j: Column) -> Column:
        return F.sqrt(-2 * F.ln(uniform(j, "a"))) * F.cos(2 * F.pi() * uniform(j, "b"))

    draws = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), normal)
    return ids.select(key, let(draws, l1_normalize).alias("vector"))
