"""Density clustering of a run's questions: leaf clusters, the rest outliers.

The measure is mutual reachability: the largest of two points' distance and their core distances,
a core distance being the distance to the fifth nearest other point. A leaf cluster is a densest
group: it starts when the single-linkage merging first brings five points together and ends when
it meets another such group. Points that join later than that are outliers. When a run has one
group only, its densest points are the cluster and all others outliers.

Three facts keep this a table job.

* Equal questions are one point with a count, so copies never meet each other.
* An edge is no part of the minimum spanning tree if lighter ones already join its ends. A first
  tree, of the edges to the nearest points and of small blocks' own trees, says for any two points
  how light that is. Points stand in the order in which this tree merges them, so the heaviest edge
  between two of them is the heaviest step from one place to the other. All pairs of points are met,
  block by block, and only edges lighter than that leave a task: a few per point, not one per pair.
* On the tree the groups are found locally. Groups under five points merge along an edge that is
  the lightest for both; any other small group hangs on its lightest edge, whose weights fall
  along the way until it ends at a big group. A big group ends at the lightest edge that leaves
  the region hanging on it, and a point belongs to it if its own edge is lighter than that.

A run of at most ``BLOCK`` distinct questions needs one block and is labelled in one task. Larger
runs take the block pairs and the joins below; besides a number per point and the first tree's
edges, nothing of theirs is gathered in one place.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import hash_embedding
from ..session import cut_lineage
from .neighbours import block_best
from .order import first_per_group
from .report import question_counts

BLOCK = 2_048
#: Blocks of a run in the work on all pairs, more when one would be over ``WIDE`` times ``BLOCK``.
SIDES = 8
WIDE = 8
NEIGHBOURS = 5
#: Rows, pairs and edges that such a task holds at a time.
_ROWS, _EXACT, _HELD = 256, 65_536, 1_000_000
GROUP = fixed.MIN_CLUSTER_SIZE

_LABELS = "run_id string, pid string, copies bigint, cluster string"


# ---- inside one task ----------------------------------------------------------------------


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences, equal vectors at exactly zero."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        out[i] = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
    return out


def _core(dist: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Distance at which ``k`` others are reached, copies counted; a point's own copies are at 0."""
    order = np.argsort(dist, axis=1, kind="stable")
    reach = np.cumsum(copies[order], axis=1) - 1
    at = np.minimum((reach >= min(k, copies.sum() - 1)).argmax(axis=1), dist.shape[1] - 1)
    return np.take_along_axis(dist, order, axis=1)[np.arange(len(dist)), at]


def _tree(reach: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree edges of a dense symmetric matrix, equal weights ordered by the edges'
    ends, so any two ways to the tree give the same one."""
    n = len(reach)
    every = np.arange(n)
    best, link = reach[0].copy(), np.zeros(n, dtype=int)
    inside = np.zeros(n, dtype=bool)
    inside[0] = True
    edges = []

    def name(other: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.minimum(other, points) * n + np.maximum(other, points)

    for _ in range(n - 1):
        open_ = np.where(inside, np.inf, best)
        tied = np.flatnonzero(open_ == open_.min())
        nxt = int(tied[name(link[tied], tied).argmin()])
        edges.append((float(best[nxt]), int(link[nxt]), nxt))
        inside[nxt] = True
        row = reach[nxt]
        closer = (row < best) | ((row == best) & (name(np.full(n, nxt), every) < name(link, every)))
        closer &= ~inside
        best[closer], link[closer] = row[closer], nxt
    return edges


def _pair_tree(vectors: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """``_tree`` of the points' mutual reachability, without the matrix of exact distances.

    Single precision, with twice its possible error to spare, says which distances can matter to a step: those not
    longer than the point's best edge so far. Only they are worked out, as ``_distances`` does.
    """
    n, every = len(vectors), np.arange(len(vectors))
    scale = float(np.abs(vectors).max(initial=0.0)) or 1.0
    small = (vectors / scale).astype(np.float32)
    square = np.einsum("ij,ij->i", small, small)
    spare = np.float32((vectors.shape[1] + 16) * 8 * np.finfo(np.float32).eps * (float(square.max(initial=0.0)) + 1e-30))
    rough = small @ small.T
    rough *= -2
    rough += square
    rough += square[:, None]

    def exact(i: int, others: np.ndarray) -> np.ndarray:
        dist = np.sqrt(((vectors[others] - vectors[i]) ** 2).sum(axis=1))
        return np.maximum(dist, np.maximum(core[i], core[others]))

    def name(other: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.minimum(other, points) * n + np.maximum(other, points)

    best, link = exact(0, every), np.zeros(n, dtype=int)
    limit = ((best / scale) ** 2).astype(np.float32) * np.float32(1 + 1e-6) + spare
    best[0], limit[0] = np.inf, -np.inf
    edges = []
    for _ in range(n - 1):
        tied = np.flatnonzero(best == best.min())
        nxt = int(tied[name(link[tied], tied).argmin()])
        edges.append((float(best[nxt]), int(link[nxt]), nxt))
        best[nxt], limit[nxt] = np.inf, -np.inf
        near = np.flatnonzero(rough[nxt] <= limit)
        row, old, ends = exact(nxt, near), best[near], link[near]
        closer = (row < old) | ((row == old) & (name(np.full(len(near), nxt), near) < name(ends, near)))
        near, row = near[closer], row[closer]
        best[near], link[near] = row, nxt
        limit[near] = ((row / scale) ** 2).astype(np.float32) * np.float32(1 + 1e-6) + spare
    return edges


def _label(edges, copies: np.ndarray, core: np.ndarray, size: int) -> list[int]:
    """Group number per point, -1 for outliers, by merging along edges from light to heavy."""
    n = len(copies)
    up, members = list(range(n)), [[i] for i in range(n)]
    weight = [int(c) for c in copies]
    group = [-1] * n  # per root: the one group in it, -1 none, -2 several
    label, joined, born = [-1] * n, [0.0] * n, []

    def start(root: int, w: float) -> None:
        group[root] = len(born)
        born.append(w)
        for i in members[root]:
            label[i], joined[i] = group[root], w

    for i in range(n):
        if weight[i] >= size:
            start(i, float(core[i]))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for w, a, b in edges:
        a, b = find(a), find(b)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        if weight[a] >= size and weight[b] >= size:
            merged = -2
        elif weight[a] >= size or weight[b] >= size:
            merged, small = (group[a], b) if weight[a] >= size else (group[b], a)
            if merged >= 0:
                for i in members[small]:
                    label[i], joined[i] = merged, w
        else:
            merged = -1
        up[b] = a
        members[a] += members[b]
        members[b] = []
        weight[a] += weight[b]
        group[a] = merged
        if merged == -1 and weight[a] >= size:
            start(a, w)
    if len(born) == 1:
        label = [0 if c == 0 and joined[i] == born[0] else -1 for i, c in enumerate(label)]
    return label


def label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of one run small enough for one task."""
    pdf = pdf.sort_values("pid", kind="stable").reset_index(drop=True)
    copies = pdf["copies"].to_numpy()
    vectors = _vectors(pdf)
    dist = _distances(vectors, vectors)
    core = _core(dist, copies, NEIGHBOURS)
    reach = np.maximum(dist, np.maximum(core[:, None], core[None, :]))
    pids = pdf["pid"].tolist()
    edges = sorted(_tree(reach), key=lambda e: (e[0], *sorted((pids[e[1]], pids[e[2]]))))
    label = _label(edges, copies, core, GROUP)
    first: dict[int, str] = {}
    for pid, c in zip(pids, label):
        first.setdefault(c, pid)
    return pd.DataFrame(
        {
            "run_id": pdf["run_id"],
            "pid": pids,
            "copies": copies,
            "cluster": [None if c < 0 else first[c] for c in label],
        }
    )


# ---- runs over one block ------------------------------------------------------------------


def _sides(rows: Column, block: int) -> Column:
    """Blocks of a run of so many points: the pairs of blocks give tasks enough, and a point's copies stay few."""
    return F.least(rows, F.greatest(F.lit(SIDES), F.ceil(rows / (WIDE * block)))).cast("int")


def _block_pairs(points: DataFrame, block: int) -> DataFrame:
    """Each point once per pair of blocks its own block is part of: (.., own, a, b)."""
    sizes = points.groupBy("run_id").agg(_sides(F.count("*"), block).alias("blocks"))
    placed = points.join(sizes, "run_id").withColumn("own", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return spread.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("blocks", "other")


def _dealt(pairs: DataFrame):
    """Block pairs as groups, over so many tasks that few meet in one: small as they are in bytes, they are most of the work."""
    spark = pairs.sparkSession
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(tasks, "run_id", "a", "b").groupBy("run_id", "a", "b")


def _near(points: DataFrame, block: int = BLOCK, k: int = NEIGHBOURS) -> DataFrame:
    """(run_id, pid, near, times, d, rank): each point's nearest few others; each pair of blocks gives some, the nearest of all stay."""
    kind = points.schema["pid"].dataType.simpleString()

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        first, second = pdf[pdf["own"] == pdf["a"]], pdf[pdf["own"] == pdf["b"]]
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        for left, right in [(first, second)] if same else [(first, second), (second, first)]:
            if left.empty or right.empty:
                continue
            left, right = (side.sort_values("pid", kind="stable") for side in (left, right))
            # A point of its own block is among its nearest, or behind more than k equals of a lower name.
            best, dist = block_best(_vectors(left), np.arange(len(right)), _vectors(right), k + same)
            keep = np.ones(best.shape, dtype=bool)
            if same:
                keep = best != np.arange(len(left))[:, None]
                keep[keep.all(axis=1), k:] = False
            at, place = np.repeat(np.arange(len(left)), keep.sum(axis=1)), best[keep]
            out.append(
                pd.DataFrame(
                    {
                        "run_id": left["run_id"].to_numpy()[at],
                        "pid": left["pid"].to_numpy()[at],
                        "near": right["pid"].to_numpy()[place],
                        "times": right["copies"].to_numpy()[place],
                        "d": dist[keep],
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=["run_id", "pid", "near", "times", "d"])

    found = _dealt(_block_pairs(points, block)).applyInPandas(near, f"run_id string, pid {kind}, near {kind}, times bigint, d double")
    return first_per_group(found, ["run_id", "pid"], [F.col("d"), F.col("near")], k)


def core_distances(points: DataFrame, near: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(run_id, pid, core) from the nearest others of each point, copies counted."""
    listed = near.groupBy("run_id", "pid").agg(F.sort_array(F.collect_list(F.struct("rank", "d", "times"))).alias("n"))
    own = _meet(points.select("run_id", "pid", "copies"), listed, ["run_id", "pid"])
    walk = F.aggregate(
        "n",
        F.struct((F.col("copies") - 1).alias("got"), F.lit(0.0).alias("d")),
        lambda acc, x: F.struct(
            (acc["got"] + x["times"]).alias("got"), F.when(acc["got"] >= k, acc["d"]).otherwise(x["d"]).alias("d")
        ),
    )
    return own.select("run_id", "pid", walk["d"].alias("core"))


def _first_edges(points: DataFrame, near: DataFrame, block: int) -> DataFrame:
    """(run_id, w, u, v): edges to the nearest points, and the trees of small blocks, which join what lies far apart."""

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid").reset_index(drop=True)
        pids = pdf["pid"].to_numpy()
        edges = _pair_tree(_vectors(pdf), pdf["core"].to_numpy())
        ends = np.sort(pids[np.array([e[1:] for e in edges], dtype=np.int64).reshape(-1, 2)], axis=1)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "w": [e[0] for e in edges], "u": ends[:, 0], "v": ends[:, 1]})

    sizes = points.groupBy("run_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = points.join(sizes, "run_id").withColumn("own", F.pmod(F.xxhash64("pid"), F.col("blocks")))
    own = placed.groupBy("run_id", "own").applyInPandas(trees, "run_id string, w double, u int, v int")
    core = points.select("run_id", F.col("pid").alias("near"), F.col("core").alias("far"))
    met = _meet(_meet(near.select("run_id", "pid", "near", "d"), points.select("run_id", "pid", "core"), ["run_id", "pid"]), core, ["run_id", "near"])
    return met.select(
        "run_id", F.greatest("d", "core", "far").alias("w"), F.least("pid", "near").alias("u"), F.greatest("pid", "near").alias("v")
    ).unionByName(own).distinct()


def _kruskal(w: np.ndarray, u: np.ndarray, v: np.ndarray, n: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(edges, order, step): the forest's edges from light to heavy; the points so that each merged group stands together;
    and per place which of the edges, by number in ``edges``, merged it with the next one, -1 between trees."""
    up, size, tail = list(range(n)), [1] * n, list(range(n))
    after, by, edges = [-1] * n, [-1] * n, []
    for e, a, b in zip((at := np.lexsort((v, u, w))).tolist(), u[at].tolist(), v[at].tolist()):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a == b:
            continue
        if size[a] < size[b]:
            a, b = b, a
        # A root is the first point of its group.
        after[tail[a]], by[tail[a]], tail[a] = b, len(edges), tail[b]
        up[b] = a
        size[a] += size[b]
        edges.append(e)
    order = []
    for i in range(n):
        if up[i] == i:
            while i >= 0:
                order.append(i)
                i = after[i]
    order = np.array(order, dtype=np.int64)
    return edges, order, np.array(by, dtype=np.int64)[order]


def _merged_order(block: int):
    """A run's first edges to (run_id, pid, pos, own, w, u, v, limit).

    ``pos``: the point's place in merging order, ``own`` its block of neighbouring places. ``w, u, v``: the tree's edge that
    merged it with the next place. ``limit``: per block the heaviest edge, with its number from light to heavy, on the way to
    the block's first place, or for a block before ``own`` to the first place of ``own``; for ``own`` the edge to the next place.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        w, u, v = (pdf[c].to_numpy() for c in ("w", "u", "v"))
        n = int(v.max()) + 1
        edges, order, step = _kruskal(w, u, v, n)
        # Number len(edges) stands for no way at all, -1 for no step.
        edge = [np.r_[w[edges], np.inf, 0.0], np.r_[u[edges], -1, -1].astype(np.int32), np.r_[v[edges], -1, -1].astype(np.int32)]
        step = np.where(step < 0, len(edges), step)
        sides = min(n, max(SIDES, -(-n // (WIDE * block))))
        start = -(-np.arange(sides + 1) * n // sides)
        own = np.repeat(np.arange(sides), np.diff(start))
        limit = np.full((n, sides), -1, dtype=np.int32)
        for c in range(sides):
            lo, hi = start[c], start[c + 1]
            limit[lo:hi, c] = step[lo:hi]
            limit[lo + 1 : hi, :c] = np.maximum.accumulate(step[lo : hi - 1])[:, None]
            way = np.maximum.accumulate(step[lo:hi][::-1])[::-1]
            for later in range(c + 1, sides):
                limit[lo:hi, later] = way
                way = np.maximum(way, step[start[later] : start[later + 1]].max())
        return pd.DataFrame(
            {
                "run_id": pdf["run_id"].iloc[0], "pid": order, "pos": np.arange(n), "own": own,
                **{c: col[step] for c, col in zip("wuv", edge)},
                "n": list(limit), **{f"l{c}": list(col[limit]) for c, col in zip("wuv", edge)},
            }
        )

    return order


_ORDERED = (
    "run_id string, pid int, pos int, own int, w double, u int, v int, "
    "n array<int>, lw array<double>, lu array<int>, lv array<int>"
)


def _forest(edges: np.ndarray) -> np.ndarray:
    """The spanning forest of edges given as rows (w, u, v)."""
    points, ends = np.unique(edges[:, 1:], return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    return edges[_kruskal(edges[:, 0], u, v, len(points))[0]]


def _lighter(pdf: pd.DataFrame) -> pd.DataFrame:
    """(run_id, w, u, v): of a pair of blocks the edges that are lighter than the first tree's way between their ends.

    Single precision, with twice its possible error to spare, says which distances can be; the others are not worked out.
    """
    pdf = pdf.sort_values("pos")
    same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
    left = pdf[pdf["own"] == pdf["a"]]
    right = left if same else pdf[pdf["own"] == pdf["b"]]
    (a, b), both = (_vectors(left), _vectors(right)), pd.concat([left, right])
    pid, core, rank, lw, lu, lv = (both[c].to_numpy() for c in ("pid", "core", "n", "lw", "lu", "lv"))
    scale = float(max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))) or 1.0
    small, few = (a / scale).astype(np.float32), (b / scale).astype(np.float32)
    square, squares = np.einsum("ij,ij->i", small, small), np.einsum("ij,ij->i", few, few)
    spare = np.float32((a.shape[1] + 16) * 8 * np.finfo(np.float32).eps * (float(max(square.max(), squares.max())) + 1e-30))
    few = np.ascontiguousarray(few.T) * np.float32(-2)
    most = ((lw / scale) ** 2).astype(np.float32) * np.float32(1 + 1e-6) + spare
    n, held, found = len(left), [], np.empty((0, 3))
    if same:  # steps from light to heavy
        steps = np.argsort(rank[: n - 1], kind="stable")
        number, limit = np.empty(n - 1, dtype=np.int64), most[steps]
        number[steps] = np.arange(n - 1)

    def keep(at: np.ndarray, to: np.ndarray, heaviest: np.ndarray) -> None:
        for i in range(0, len(at), _EXACT):
            x, y, h = at[i : i + _EXACT], to[i : i + _EXACT], heaviest[i : i + _EXACT]
            w = np.maximum(np.sqrt(((b[y] - a[x]) ** 2).sum(axis=1)), np.maximum(core[x], core[n + y]))
            u, v = np.minimum(pid[x], pid[n + y]), np.maximum(pid[x], pid[n + y])
            less = (w < lw[h]) | ((w == lw[h]) & ((u < lu[h]) | ((u == lu[h]) & (v < lv[h]))))
            held.append(np.column_stack([w[less], u[less], v[less]]))

    for lo in range(0, n, _ROWS):
        rough = small[lo : lo + _ROWS] @ few
        rough += squares
        rough += square[lo : lo + _ROWS, None]
        if same:
            for i in range(lo, min(lo + _ROWS, n - 1)):
                way = np.maximum.accumulate(number[i:])
                to = np.flatnonzero(rough[i - lo, i + 1 :] <= limit[way])
                keep(np.full(len(to), i), i + 1 + to, steps[way[to]])
        else:
            at, to = np.divmod(np.flatnonzero(rough <= np.maximum(most[lo : min(lo + _ROWS, n), None], most[n:])), len(right))
            at += lo
            keep(at, to, np.where(rank[at] >= rank[n + to], at, n + to))
        if lo + _ROWS >= n or sum(map(len, held)) > _HELD:
            found, held = np.concatenate([found, *held]), []
            found = _forest(found) if len(found) > _HELD else found
    return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "w": found[:, 0], "u": found[:, 1].astype(np.int64), "v": found[:, 2].astype(np.int64)})


def _candidate_edges(points: DataFrame, near: DataFrame, block: int) -> DataFrame:
    """(run_id, w, u, v): the first tree's edges, and all others lighter than its way between their ends."""
    first = _first_edges(points, near, block)
    ordered = cut_lineage(first.groupBy("run_id").applyInPandas(_merged_order(block), _ORDERED))
    placed = _meet(points.select("run_id", "pid", "core", "vector"), ordered.drop("w", "u", "v"), ["run_id", "pid"])
    spread = placed.select("run_id", "pid", "core", "vector", "pos", "own", F.posexplode(F.arrays_zip("n", "lw", "lu", "lv")).alias("other", "limit"))
    pairs = spread.select("*", "limit.*", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).drop("other", "limit")
    lighter = _dealt(pairs).applyInPandas(_lighter, "run_id string, w double, u int, v int")
    return ordered.filter("u >= 0").select("run_id", "w", "u", "v").unionByName(lighter)


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two tables that hold a row per point or edge. They stay among the executors: left to its estimates, Spark
    takes many of these for small and sends each whole through the driver, round after round."""
    return left.join(right.hint("merge"), on, how)


def _edge() -> Column:
    """Edges in one fixed total order."""
    return F.struct("w", "u", "v")


def _ends(edges: DataFrame, home: DataFrame) -> DataFrame:
    """Edges that leave their component, with the component of either end: (run_id, w, u, v, cu, cv)."""
    at_u = home.select("run_id", F.col("pid").alias("u"), F.col("comp").alias("cu"))
    at_v = home.select("run_id", F.col("pid").alias("v"), F.col("comp").alias("cv"))
    return _meet(_meet(edges, at_u, ["run_id", "u"]), at_v, ["run_id", "v"]).filter(F.col("cu") != F.col("cv"))


def _lightest(ends: DataFrame) -> DataFrame:
    """(run_id, comp, e, to): each component's lightest leaving edge and where it goes."""
    sides = ends.select("run_id", F.inline(F.array(
        F.struct(F.col("cu").alias("comp"), _edge().alias("e"), F.col("cv").alias("to")),
        F.struct(F.col("cv").alias("comp"), _edge().alias("e"), F.col("cu").alias("to")),
    )))
    return sides.groupBy("run_id", "comp").agg(F.min(F.struct("e", "to")).alias("m")).select("run_id", "comp", "m.e", "m.to")


def _follow(pointers: DataFrame) -> DataFrame:
    """(run_id, comp, to) with ``to`` replaced by the end of its chain; ends point to themselves."""
    while True:
        nxt = pointers.select("run_id", F.col("comp").alias("to"), F.col("to").alias("far"))
        moved = _meet(pointers, nxt, ["run_id", "to"]).select(
            "run_id", "comp", F.col("far").alias("to"), (F.col("to") != F.col("far")).alias("moved")
        )
        moved = cut_lineage(moved)
        pointers = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return pointers


def spanning_tree(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """The minimum spanning tree of each run: every component takes its lightest leaving edge, round
    by round. Components at least halve each time."""
    home = points.select("run_id", "pid", F.col("pid").alias("comp"))
    edges, tree = candidates, []
    while True:
        ends = cut_lineage(_ends(edges, home))
        if ends.isEmpty():
            return reduce(DataFrame.unionByName, tree).distinct()
        lightest = cut_lineage(_lightest(ends))
        tree.append(lightest.select("run_id", "e.w", "e.u", "e.v"))
        # Two components that chose the same edge would point at each other: the lower name is the end.
        back = lightest.select("run_id", F.col("comp").alias("to"), F.col("to").alias("back"))
        pointers = _meet(lightest, back, ["run_id", "to"]).select(
            "run_id", "comp",
            F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to"),
        )
        ends_at = _follow(pointers)
        home = cut_lineage(
            _meet(home, ends_at, ["run_id", "comp"], "left").select("run_id", "pid", F.coalesce("to", "comp").alias("comp"))
        )
        edges = ends.select("run_id", "w", "u", "v")


def _grow(points: DataFrame, tree: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Merge small components along edges lightest for both until none is left to merge.

    Returns (run_id, pid, comp) and (run_id, comp, n, born): ``born`` is the weight at which the
    component reached ``size``, NULL while it is small.
    """
    home = points.select("run_id", "pid", F.col("pid").alias("comp"))
    comps = points.select(
        "run_id", F.col("pid").alias("comp"), F.col("copies").alias("n"), F.when(F.col("copies") >= size, F.col("core")).alias("born")
    )
    while True:
        small = comps.filter(F.col("n") < size).select("run_id", "comp")
        wish = _meet(_lightest(_ends(tree, home)), small, ["run_id", "comp"])
        other = wish.select("run_id", F.col("comp").alias("to"), F.col("e").alias("e2"))
        both = _meet(wish, other, ["run_id", "to"]).filter((F.col("e") == F.col("e2")) & (F.col("comp") < F.col("to")))
        merges = cut_lineage(both.select("run_id", F.col("to").alias("comp"), F.col("comp").alias("into"), F.col("e.w").alias("w")))
        if merges.isEmpty():
            return home, comps
        home = cut_lineage(
            _meet(home, merges, ["run_id", "comp"], "left").select("run_id", "pid", F.coalesce("into", "comp").alias("comp"))
        )
        moved = _meet(comps, merges, ["run_id", "comp"], "left")
        grown = moved.groupBy("run_id", F.coalesce("into", "comp").alias("comp")).agg(
            F.sum("n").alias("n"), F.max("born").alias("was"), F.max("w").alias("w")
        )
        comps = cut_lineage(
            grown.select("run_id", "comp", "n", F.coalesce("was", F.when(F.col("n") >= size, F.col("w"))).alias("born"))
        )


def tree_labels(points: DataFrame, tree: DataFrame, size: int = GROUP) -> DataFrame:
    """(run_id, pid, copies, cluster) from a spanning tree (run_id, w, u, v); ``points`` carry core."""
    home, comps = _grow(points, tree, size)
    big = comps.filter(F.col("born").isNotNull()).select("run_id", "comp", "born")
    ends = _ends(tree, home)
    hang = _meet(_lightest(ends), big.select("run_id", "comp"), ["run_id", "comp"], "left_anti")
    pointers = hang.select("run_id", "comp", "to").unionByName(big.select("run_id", "comp", F.col("comp").alias("to")))
    region = _follow(pointers).withColumnRenamed("to", "core_comp")
    region_of = _meet(home, region, ["run_id", "comp"]).select("run_id", "pid", F.col("core_comp").alias("comp"))
    leaves = _lightest(_ends(tree, region_of)).select("run_id", F.col("comp").alias("core_comp"), F.col("e").alias("end"))
    alone = big.groupBy("run_id").agg((F.count("*") == 1).alias("alone"))
    judged = (
        _meet(_meet(region, hang.select("run_id", "comp", "e"), ["run_id", "comp"], "left"), leaves, ["run_id", "core_comp"], "left")
        .join(big.select("run_id", F.col("comp").alias("core_comp"), "born").hint("merge"), ["run_id", "core_comp"])
        .join(alone, "run_id")
    )
    core_itself = F.col("e").isNull()
    inside = core_itself | F.when(F.col("alone"), F.col("e.w") == F.col("born")).otherwise(F.col("e") < F.col("end"))
    cluster = judged.select("run_id", "comp", F.when(inside, F.col("core_comp")).alias("cluster"))
    return (
        _meet(_meet(points.select("run_id", "pid", "copies"), home, ["run_id", "pid"]), cluster, ["run_id", "comp"], "left")
        .select("run_id", "pid", "copies", "cluster")
    )


# ---- entry points -------------------------------------------------------------------------


def question_points(questions: DataFrame, embed=hash_embedding, run: str = "run_id", text: str = "prompt") -> DataFrame:
    """(run_id, pid, copies, vector): the distinct questions of runs with more than ten of them."""
    distinct = question_counts(questions.select(F.col(run).cast("string").alias("run_id"), F.col(text).alias("text")), "run_id", "text")
    large = (
        distinct.groupBy("run_id").agg(F.count("*").alias("n")).filter(F.col("n") > fixed.MAX_LITERAL_CLUSTERS).select("run_id")
    )
    return distinct.join(large, "run_id").select("run_id", F.md5("text").alias("pid"), "copies", embed(F.col("text")).alias("vector"))


def labels(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, pid, copies, cluster): ``cluster`` is a point's id standing for its group, NULL for
    outliers. Run sizes are looked at first; only runs over one block take the long way."""
    sizes = points.groupBy("run_id").agg(F.count("*").alias("n"))
    over = sizes.filter(F.col("n") > block).select("run_id")
    if over.isEmpty():
        return points.groupBy("run_id").applyInPandas(label_block, _LABELS)
    small = points.join(over, "run_id", "left_anti").groupBy("run_id").applyInPandas(label_block, _LABELS)
    # Points go by number, in the order of their names.
    number = (F.row_number().over(Window.partitionBy("run_id").orderBy("pid")) - 1).cast("int")
    large = cut_lineage(points.join(over, "run_id", "left_semi").withColumn("number", number))
    named = large.select("run_id", F.col("number").alias("pid"), F.col("pid").alias("name"))
    large = large.select("run_id", F.col("number").alias("pid"), "copies", "vector")
    near = cut_lineage(_near(large, block))
    cored = cut_lineage(_meet(large, core_distances(large, near), ["run_id", "pid"]))
    tree = cut_lineage(spanning_tree(cored, cut_lineage(_candidate_edges(cored, near, block))))
    found = _meet(tree_labels(cored, tree), named, ["run_id", "pid"])
    group = named.select("run_id", F.col("pid").alias("cluster"), F.col("name").alias("group"))
    return small.unionByName(
        _meet(found, group, ["run_id", "cluster"], "left").select("run_id", F.col("name").alias("pid"), "copies", F.col("group").alias("cluster"))
    )


def cluster_counts(labelled: DataFrame) -> DataFrame:
    """(run_id, num_clusters, num_outliers); copies of an outlier all count."""
    per = labelled.groupBy("run_id", "cluster").agg(F.sum("copies").alias("n"))
    return per.groupBy("run_id").agg(
        F.count("cluster").alias("num_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0)).alias("num_outliers"),
    )
