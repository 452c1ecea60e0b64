"""Centroid clustering on integers with an incremental distance matrix.

Vectors become integers once. Each keeps its exact dot product with every centroid in a stored table; a round
reads that table, adds for each centroid only what its changed components contribute (component times change, the
components that stay are not looked at), and picks the nearest centroid from

    |x|^2 - 2 x.c + |c|^2

all in 64-bit integers, so no rounding error gathers over rounds and ties are real ties. A round is one pass that
stores the next table and one grouped sum of k x dims numbers, all that the driver sees; vectors never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = 1
#: Components beyond this would take a squared distance of 64 components out of 64 bits.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): components floor(scale * x) of the rows with exactly ``dims`` components, none null or non-finite.

    Rows with a component of magnitude ``LARGEST`` or more have no exact 64-bit distance and are left out too, as
    are null vectors. Rows that repeat a vec_id are vectors of their own.
    """
    x = F.col("embedding").cast("array<double>")
    fit = (F.size(x) == dims) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST / scale))
    )
    return vectors.filter(F.coalesce(fit, F.lit(False))).select(
        "vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("x")
    )


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hash of their id; fewer rows give fewer centroids. Rows without an id start none;
    of rows that share one, the smaller vectors come first."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.filter(F.col("vec_id").isNotNull()).select(rank.alias("rank"), "x").orderBy("rank", "x").limit(k).collect()
    return np.array([r["x"] for r in chosen], dtype=np.int64)


def _state_schema(kept: DataFrame) -> str:
    return f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, x array<int>, dots array<bigint>, cluster int, distance bigint"


def _lists(rows: np.ndarray, kind) -> pa.ListArray:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """``rows`` with ``dots``, ``cluster`` and ``distance`` for ``centroids``.

    Without ``before`` the products are worked out in full; else ``rows`` hold those of the centroids ``before``, and
    only changed components are added.
    """
    k, dims = centroids.shape
    norms = (centroids**2).sum(axis=1)
    change = centroids if before is None else centroids - before
    moved = [(c, np.flatnonzero(change[c])) for c in range(k)]
    moved = [(c, at, change[c][at]) for c, at in moved if len(at)]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column(1), dims)
            dots = np.zeros((len(x), k), dtype=np.int64) if before is None else _matrix(part.column(2), k)
            for c, at, by in moved:
                dots[:, c] += x[:, at] @ by
            far = norms - 2 * dots
            cluster = far.argmin(axis=1)
            distance = (x**2).sum(axis=1) + far[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists(x, pa.int32()), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                ["vec_id", "x", "dots", "cluster", "distance"],
            )

    columns = ["vec_id", "x"] if before is None else ["vec_id", "x", "dots"]
    return rows.select(*columns).mapInArrow(step, _state_schema(rows))


def _sums(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster its number of rows and component sums; a row per task and cluster moves."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = {}, {}
        for part in parts:
            x, cluster = _matrix(part.column(0), dims), part.column(1).to_numpy(zero_copy_only=False)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                counts[c] = counts.get(c, 0) + len(mine)
                sums[c] = sums.get(c, 0) + mine.sum(axis=0)
        names = sorted(counts)
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([counts[c] for c in names], pa.int64()), _lists(np.stack([sums[c] for c in names]), pa.int64())],
                ["cluster", "n", "s"],
            )

    partial = state.select("x", "cluster").mapInArrow(add, "cluster int, n bigint, s array<bigint>")
    each = partial.select("cluster", "n", F.posexplode("s").alias("j", "s"))
    added = each.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # k x dims rows
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(added, key=lambda r: r["j"]):
        found.setdefault(r["cluster"], (r["n"], []))[1].append(r["s"])
    return found


@dataclass(frozen=True)
class Clustering:
    """Stored rows (vec_id, x, dots, cluster, distance) and the final centroids, k x dims integers."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> Clustering:
    """``rounds`` rounds of assigning and averaging, then a last assignment.

    Nearest is the smallest squared distance, the smaller number on a tie; a centroid becomes the exact floor of its
    vectors' mean, an empty one stays. Without a vector to start from no row comes out.
    """
    kept = integer_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        none = kept.filter(F.lit(False)).select(
            "vec_id", "x", F.array().cast("array<bigint>").alias("dots"), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")
        )
        return Clustering(none, np.zeros((0, dims), dtype=np.int64))
    state = cut_lineage(_assigned(kept, centroids, None))
    for _ in range(rounds):
        after = centroids.copy()
        for c, (n, sums) in _sums(state, dims).items():
            after[c] = [s // n for s in sums]
        state, centroids = cut_lineage(_assigned(state, after, centroids)), after
    return Clustering(state, centroids)


def _of_cluster(values: list, kind: str) -> Column:
    """The value at the row's cluster, from a list of one per cluster."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))


def report(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector."""
    import hashlib

    k = len(found.centroids)
    if not k:
        return found.rows.select(
            "vec_id", "cluster", "distance", F.lit(0).cast("bigint").alias("cluster_inertia"),
            F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"),
        )
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint").alias("d")).collect()
    per = {r["cluster"]: r["d"] for r in sums}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    return found.rows.select(
        "vec_id", "cluster", "distance",
        _of_cluster([per.get(c, 0) for c in range(k)], "bigint").alias("cluster_inertia"),
        F.lit(sum(per.values())).cast("bigint").alias("inertia"),
        _of_cluster(digests, "string").alias("centroid_sha256"),
    )
