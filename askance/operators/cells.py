"""Exact nearest-neighbour join over a metric index: cells around pivots, cut into rings.

``neighbours.nearest`` meets every query with every term. Here the terms are laid out so that most pairs are ruled
out unseen, and the result is the same:

* pivots are learned from a bounded sample; a term belongs to the cell of its nearest pivot, and a cell is cut by the
  distance to its pivot into rings of about ``BLOCK`` rows. A ring is known by its cell and its least and greatest
  distance: a few numbers, at most ``MOST_RINGS`` rows in all, which travel to the tasks;
* a query first meets the rings most likely to hold its neighbours, until they hold k terms. The k-th distance found
  there bounds the true one from above;
* it then goes to those of the other rings that two inequalities cannot rule out. By the triangle inequality no
  term of a ring is nearer than the gap between the query's distance to the pivot and the ring's. And a term is nearer
  to its own pivot c than to the query's, p, so it is no nearer than (d(q,c)^2 - d(q,p)^2) / (2 d(c,p)).

Terms with equal vectors are one point that stands for its k smallest ids, so copies do not fill rings. A ring that
is still large is dealt to several tasks by hash, and so are the queries that meet at a ring: no task holds more than
about ``BLOCK`` terms and ``SHARD`` queries. Where vectors have no clusters, as random ones in many dimensions, nothing
can be ruled out and every pair is met, block by block; ``NeighbourJoin.work`` says how many were. If then the queries are
many, each would be sent to each block: blocks that are open to most queries are put together, up to ``JOINED`` terms
and queries a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut_lineage
from .neighbours import block_best
from .order import first_per_group

#: Terms of a block and queries of a shard, about.
BLOCK = 1_024
SHARD = 4_096
#: Rows of a side where blocks are put together, at most; smaller tables make ``SIDES`` parts.
JOINED = 32_768
SIDES = 8
#: Bounds of what travels: pivots, the sample they are learned from, and rings.
MOST_PIVOTS = 1_024
SAMPLE = 20_000
RINGS_PER_CELL = 64
MOST_RINGS = MOST_PIVOTS * RINGS_PER_CELL
_LLOYD_ROUNDS = 5
#: Distances worked out by products err by less than this share of the vectors' length.
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] - 2.0 * rows @ pivots.T + (pivots**2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0.0))


def learn_pivots(vectors: DataFrame, vector: str, count: int, seed: int = fixed.EVAL_SEED) -> np.ndarray:
    """``count`` pivots, at most, of the ``SAMPLE`` rows of least hash: each the row farthest from those before it, so
    that no group of vectors goes without one, then moved to the means of their cells in a few rounds."""
    draw = F.xxhash64(vector, F.lit(seed))
    rows = vectors.select(vector).orderBy(draw, vector).limit(SAMPLE).collect()
    sample = np.array([r[0] for r in rows], dtype=np.float64)
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen]
    for _ in range(_LLOYD_ROUNDS):
        cell = _distances(sample, pivots).argmin(axis=1)
        sizes = np.bincount(cell, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, sample)
        pivots = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], pivots)
    return pivots


@dataclass(frozen=True)
class Layout:
    """Pivots, and per ring its cell, least and greatest distance to the pivot, rows, blocks and first block; per block
    the part it is met in, a part being one block or several."""

    pivots: np.ndarray
    edges: list[np.ndarray]
    first_ring: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray
    first_block: np.ndarray
    part: np.ndarray

    def sizes(self) -> np.ndarray:
        """Terms of each part, about."""
        return np.bincount(self.part, weights=np.repeat(self.rows / self.blocks, self.blocks))

    def joined(self, most: int) -> Layout:
        """The same rings, neighbouring blocks put together to parts of about ``most`` terms."""
        each = np.repeat(self.rows / self.blocks, self.blocks)
        _, part = np.unique(((np.cumsum(each) - each / 2) // most).astype(np.int64), return_inverse=True)
        return replace(self, part=part)

    def least(self, q: np.ndarray) -> np.ndarray:
        """Queries x rings: no term of the ring is nearer than this. Rings without rows are infinitely far."""
        to_pivot = _distances(q, self.pivots)
        own = to_pivot.argmin(axis=1)
        between = _distances(self.pivots, self.pivots)[own]
        nearest = to_pivot[np.arange(len(q)), own][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (to_pivot**2 - nearest**2) / (2.0 * between), 0.0)
        far = to_pivot[:, self.cell]
        least = np.maximum(np.maximum(far - self.high, self.low - far), plane[:, self.cell])
        slack = _SLACK * (1.0 + np.linalg.norm(q, axis=1)[:, None] + np.linalg.norm(self.pivots, axis=1).max())
        least = np.maximum(least - slack, 0.0)
        least[:, self.rows == 0] = np.inf
        return least

    def probable(self, least: np.ndarray, k: int) -> np.ndarray:
        """Queries x rings, true for the rings of least bound that together hold k terms."""
        order = np.argsort(least, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        chosen = np.zeros(least.shape, dtype=bool)
        np.put_along_axis(chosen, order, held < k, axis=1)
        return chosen & np.isfinite(least)

    def parts_of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, part) for the parts of each wanted ring's blocks."""
        at, ring = np.nonzero(wanted)
        times = self.blocks[ring]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        met = np.unique(np.repeat(at, times) * len(self.part) + self.part[np.repeat(self.first_block[ring], times) + inside])
        return np.divmod(met, len(self.part))


def _placed(vocab: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(term_ids, embedding, cell, gap): each term's nearest pivot and the distance to it."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            far = _distances(_matrix(part.column(1)), pivots)
            cell = far.argmin(axis=1)
            gap = far[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(cell, pa.int32()), pa.array(gap, pa.float64())], [*part.schema.names, "cell", "gap"]
            )

    return vocab.mapInArrow(place, "term_ids array<bigint>, embedding array<double>, cell int, gap double")


def _in_rings(placed: DataFrame, edges: list[np.ndarray], first_ring: np.ndarray) -> DataFrame:
    """``placed`` with the number of its ring."""

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cell, gap = part.column(2).to_numpy(), part.column(3).to_numpy()
            ring = [int(first_ring[c]) + int(np.searchsorted(edges[c], g, side="right")) for c, g in zip(cell, gap)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), pa.array(ring, pa.int32())], ["term_ids", "embedding", "gap", "ring"]
            )

    return placed.mapInArrow(number, "term_ids array<bigint>, embedding array<double>, gap double, ring int")


def lay_out(placed: DataFrame, pivots: np.ndarray, block: int) -> tuple[Layout, DataFrame]:
    """The layout of stored terms, and the terms with their ring. At most ``MOST_RINGS`` rows reach the driver."""
    shares = [i / RINGS_PER_CELL for i in range(1, RINGS_PER_CELL)]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("gap", shares, 1_000).alias("at")).collect()
    edges = [np.zeros(0) for _ in pivots]
    for r in cells:
        rings = min(RINGS_PER_CELL, -(-r["n"] // block))
        edges[r["cell"]] = np.array([r["at"][RINGS_PER_CELL * i // rings - 1] for i in range(1, rings)])
    sizes = np.array([len(e) + 1 for e in edges])
    first_ring = np.cumsum(sizes) - sizes
    ringed = _in_rings(placed, edges, first_ring)
    low, high, rows = np.zeros(sizes.sum()), np.zeros(sizes.sum()), np.zeros(sizes.sum(), dtype=np.int64)
    for r in ringed.groupBy("ring").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n")).collect():
        low[r["ring"]], high[r["ring"]], rows[r["ring"]] = r["low"], r["high"], r["n"]
    blocks = np.maximum(1, -(-rows // (2 * block)))
    layout = Layout(
        pivots, edges, first_ring, np.repeat(np.arange(len(pivots)), sizes), low, high, rows, blocks, np.cumsum(blocks) - blocks,
        np.arange(blocks.sum()),
    )
    return layout, ringed


def _dealt(points: DataFrame, layout: Layout, k: int, later: bool, shards: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """Where each query goes: (block, n) per task without ``shards``, else (block, shard, q_id, vector).

    First to the probable rings; ``later``, with the column ``bound``, to all others not ruled out, or with ``whole`` to
    all that are not ruled out.
    """

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 512):
                some = part.slice(lo, 512)
                least = layout.least(_matrix(some.column(1)))
                wanted = np.zeros(least.shape, dtype=bool) if whole else layout.probable(least, k)
                if later:
                    wanted = ~wanted & (least <= some.column(2).to_numpy()[:, None]) & np.isfinite(least)
                at, block = layout.parts_of(wanted)
                if shards is None:
                    block, n = np.unique(block, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(n, pa.int64())], ["block", "n"])
                    continue
                ids = some.column(0).take(pa.array(at))
                spread = ids.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                shard = (spread % shards[block].astype(np.uint64)).astype(np.int32)
                for cut in range(0, len(at), 8_192):
                    s = slice(cut, cut + 8_192)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[s], pa.int32()), pa.array(shard[s]), ids[s], some.column(1).take(pa.array(at[s]))],
                        ["block", "shard", "q_id", "vector"],
                    )

    kind = "block int, n bigint" if shards is None else "block int, shard int, q_id bigint, vector array<double>"
    return points.mapInArrow(deal, kind)


_FOUND = "q_id bigint, term_id bigint, distance double"


def _scan(points: DataFrame, ringed: DataFrame, layout: Layout, k: int, later: bool) -> tuple[DataFrame, DataFrame, bool]:
    """(found, met, whole): up to k terms per query and part; queries, and about how many terms, that met there; and
    whether the queries went to the rings met first once more, since those are part of larger ones now."""

    def visited() -> tuple[DataFrame, np.ndarray]:
        visits = cut_lineage(_dealt(points, layout, k, later, whole=whole).groupBy("block").agg(F.sum("n").alias("n")))
        counts = np.zeros(len(layout.sizes()), dtype=np.int64)
        for r in visits.collect():  # a row per part
            counts[r["block"]] = r["n"]
        return visits, counts

    whole, shard = False, SHARD
    visits, counts = visited()
    if later and counts.max(initial=0) > SHARD and 2 * counts.sum() > (asked := points.count()) * np.count_nonzero(layout.sizes()):
        whole, shard = True, max(SHARD, min(JOINED, asked // SIDES))
        layout = layout.joined(max(BLOCK, min(JOINED, int(layout.rows.sum()) // SIDES)))
        visits, counts = visited()
    shards = np.maximum(1, -(-counts // shard))
    queries = _dealt(points, layout, k, later, shards, whole)

    def copies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's terms once per shard of its queries; a block that no query visits stays behind."""
        for part in parts:
            ring, ids = part.column(3).to_numpy(), part.column(0)
            first = pa.compute.list_element(ids, 0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            block = layout.first_block[ring] + (first % layout.blocks[ring].astype(np.uint64)).astype(np.int64)
            block = layout.part[block]
            times = np.where(counts[block] > 0, shards[block], 0)
            at = np.repeat(np.arange(len(block)), times)
            shard = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            for cut in range(0, len(at), 8_192):
                s = slice(cut, cut + 8_192)
                take = pa.array(at[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[at[s]], pa.int32()), pa.array(shard[s], pa.int32()), ids.take(take), part.column(1).take(take)],
                    ["block", "shard", "term_ids", "embedding"],
                )

    terms = ringed.mapInArrow(copies, "block int, shard int, term_ids array<bigint>, embedding array<double>")

    def best(q: pa.Table, t: pa.Table) -> pa.Table:
        names = ["q_id", "term_id", "distance"]
        if not q.num_rows or not t.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        listed = t.column("term_ids").combine_chunks()
        firsts = pa.compute.list_element(listed, 0).to_numpy()
        got, far = block_best(_matrix(q.column("vector")), firsts, _matrix(t.column("embedding")), k)
        ids = q.column("q_id").to_numpy()
        out = [np.repeat(ids, got.shape[1]), got.ravel(), far.ravel()]
        more = {int(r[0]): r[1:] for r in listed.to_pylist() if len(r) > 1}
        if more:  # the ids of a point that stands for several terms
            at = [i for i, term in enumerate(out[1].tolist()) for _ in more.get(term, ())]
            extra = [other for term in out[1].tolist() for other in more.get(term, ())]
            out = [np.append(out[0], out[0][at]), np.append(out[1], np.array(extra, dtype=np.int64)), np.append(out[2], out[2][at])]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names)

    keys = ["block", "shard"]
    sizes = ringed.sparkSession.createDataFrame([(b, float(n)) for b, n in enumerate(layout.sizes())], "block int, terms double")
    met = visits.join(F.broadcast(sizes), "block")
    return queries.groupBy(*keys).cogroup(terms.groupBy(*keys)).applyInArrow(best, _FOUND), met, whole


@dataclass(frozen=True)
class NeighbourJoin:
    """(q_id, term_id, distance, rank) rows, and one row of ``work``: queries, distinct vectors, pairs met, their share of all."""

    rows: DataFrame
    work: DataFrame


def nearest(points: DataFrame, vocab: DataFrame, k: int = fixed.NEAREST_TERMS, block: int = BLOCK) -> NeighbourJoin:
    """The k nearest terms of each point by Euclidean distance, ties by id: what ``neighbours.nearest`` gives.

    ``points``: q_id (unique), vector. ``vocab``: term_id (unique), embedding. Rows with a null id or vector take no
    part; vectors hold finite numbers and have one length. With fewer than k terms all are found; without a term, none.
    """
    asked = points.filter("q_id IS NOT NULL AND vector IS NOT NULL").select(
        F.col("q_id").cast("bigint").alias("q_id"), F.col("vector").cast("array<double>").alias("vector")
    )
    given = vocab.filter("term_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("term_id").cast("bigint").alias("term_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    # Of equal vectors the k smallest ids are enough; each task keeps its own k before rows move.
    alike = first_per_group(given, ["embedding"], [F.col("term_id")], k)
    distinct = cut_lineage(alike.groupBy("embedding").agg(F.sort_array(F.collect_list("term_id")).alias("term_ids"))).select("term_ids", "embedding")
    n = distinct.count()
    if not n:
        empty = asked.limit(0).select("q_id", F.col("q_id").alias("term_id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        return NeighbourJoin(empty, asked.agg(F.count("*").alias("queries")).select("queries", *_no_work()))
    block = max(block, -(-n // MOST_RINGS))
    pivots = learn_pivots(distinct, "embedding", min(MOST_PIVOTS, max(1, 2 * n // block)))
    layout, ringed = lay_out(cut_lineage(_placed(distinct, pivots)), pivots, block)

    first, visits, _ = _scan(asked, ringed, layout, k, later=False)
    first = cut_lineage(first)
    # A query met two rings or so, each handing on k rows at most, and the further ids of equal vectors.
    place = Window.partitionBy("q_id").orderBy("distance", "term_id")
    kth = first.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k).groupBy("q_id").agg(
        F.when(F.count("*") == k, F.max("distance")).otherwise(float("inf")).alias("bound")
    )
    bounded = cut_lineage(asked.join(kth, "q_id").select("q_id", "vector", "bound"))
    rest, more, whole = _scan(bounded, ringed, layout, k, later=True)
    rows = first_per_group(rest if whole else first.unionByName(rest), ["q_id"], [F.col("distance"), F.col("term_id")], k)

    pairs = visits.unionByName(more).agg(F.round(F.sum(F.col("n") * F.col("terms"))).cast("bigint").alias("pairs"))
    work = asked.agg(F.count("*").alias("queries")).crossJoin(pairs).select(
        "queries", F.lit(n).cast("bigint").alias("terms"), F.coalesce("pairs", F.lit(0)).alias("pairs"),
        F.try_divide(F.col("pairs").cast("double"), F.col("queries") * F.lit(float(n))).alias("share"),
    )
    return NeighbourJoin(rows.withColumn("rank", F.col("rank").cast("int")), work)


def _no_work():
    return [F.lit(0).cast("bigint").alias("terms"), F.lit(0).cast("bigint").alias("pairs"), F.lit(None).cast("double").alias("share")]
