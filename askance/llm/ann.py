"""Nearest neighbours by inner product: inverted lists with an adaptive scan of dimensions.

Lists are cut by spherical k-means on a bounded sample; every vector goes into the list of its nearest
centre. A query probes lists, best centre first, until they hold ``PROBED_SHARE`` of all vectors (and more
than it needs): first the nearest list, and as many more as k candidates take; then, with the k-th best score
found there as its bound, all the others. Within a list, vectors are turned by one random rotation and read in
blocks of columns. An inner product of at least b means a squared distance of at most |q|^2 + |x|^2 - 2b. Under a
random rotation the share of a squared distance that falls into d of D columns follows Beta(d/2, (D-d)/2); the
hypothesis that a candidate lies within the bound is rejected, and the candidate abandoned, when its partial
distance exceeds that law's quantile of the bound, so that of the true neighbours about ``REJECTED`` are lost at
each test. b is the query's bound or the k-th best of the list's first rows, whichever is higher. What survives is
scored exactly, on the original vectors, in double precision.

Lists are dealt in blocks of at most about ``BLOCK_ROWS`` vectors and queries in shards of at most about
``SHARD_ROWS``, by hash, so a list that holds a third of all vectors is many tasks and no task holds more
than one block and one shard; a block hands on at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

K = 20
#: The bound of the fit: vectors that the centres are learned from, and the number of lists.
SAMPLE_ROWS = 20_000
MOST_LISTS = 1_024
PROBED_SHARE = 0.75
#: The share of those within the bound that a test may reject, and the share of survivors below which only they are read on.
REJECTED = 0.01
_FEW = 0.2
COLUMNS_PER_STEP = 16
BLOCK_ROWS = 8_192
SHARD_ROWS = 4_096
_TILE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): vectors that take part, one row per vec_id.

    Null and zero vectors, those with null or non-finite components, those without an id, and those of
    another dimension than most have take no part. Rows that repeat a vec_id are one vector, the least
    array among them.
    """
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    good = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite)
    one = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.withColumn("dim", F.size("embedding"))


def _kmeans(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """Unit centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = units[rng.choice(len(units), lists, replace=False)]
    for _ in range(rounds):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _rotation(dim: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def share_quantile(part: int, whole: int, rejected: float = REJECTED) -> float:
    """The share of a squared length that ``part`` of ``whole`` columns exceed with probability ``rejected``
    after a random rotation: a quantile of Beta(part/2, (whole-part)/2), by summing its density."""
    if part >= whole:
        return 1.0
    x = (np.arange(200_000) + 0.5) / 200_000
    log = (part / 2 - 1) * np.log(x) + ((whole - part) / 2 - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(log - log.max()))
    return float(x[min(len(x) - 1, np.searchsorted(mass, (1 - rejected) * mass[-1]))])


def _scan(ids, x, query_ids, q, bound, rotation, k, rejected, step):
    """The k best of one block for every query of one shard: (query_id, vec_id, score) arrays, and the number of
    pairs and of those that all tests let through."""
    dim = x.shape[1]
    turned, asked = x @ rotation, q @ rotation
    cuts = list(range(step, dim, step)) + [dim]
    limits = [share_quantile(cut, dim, rejected) for cut in cuts]
    seen_x, seen_q = np.cumsum(turned**2, axis=1), np.cumsum(asked**2, axis=1)
    # Slack for the rounding of partial sums, so that no candidate that ties is lost to it.
    slack = 1e-9 * np.sqrt(seen_x[:, -1].max()) if len(x) else 0.0
    out, pairs, through = [], 0, 0
    for lo in range(0, len(q), _TILE):
        tile = slice(lo, min(lo + _TILE, len(q)))
        own = query_ids[tile][:, None] == ids[None, :]
        # the k-th best of a first few rows, seen whole, is a bound too
        head = min(len(x), max(4 * k, 64))
        seen = np.where(own[:, :head], -np.inf, q[tile] @ x[:head].T)
        enough = (seen > -np.inf).sum(axis=1) >= k
        bar = np.where(enough, -np.partition(-seen, min(k, head) - 1, axis=1)[:, min(k, head) - 1], -np.inf)
        bar = np.maximum(bar, bound[tile]) - slack * np.sqrt(seen_q[tile, -1])
        allowed = seen_q[tile, -1][:, None] + seen_x[:, -1][None, :] - 2 * bar[:, None]
        alive, value = ~own, np.zeros(own.shape)
        row = col = None
        start = 0
        for cut, limit in zip(cuts, limits):
            if row is None:
                value += asked[tile, start:cut] @ turned[:, start:cut].T
                if cut < dim:
                    apart = seen_q[tile, cut - 1][:, None] + seen_x[:, cut - 1][None, :] - 2 * value
                    alive &= apart <= limit * allowed + slack
                if cut == dim or np.count_nonzero(alive) < _FEW * alive.size:
                    # from here on only the survivors are read
                    row, col = np.nonzero(alive)
                    value, allowed = value[row, col], allowed[row, col]
            else:
                more = np.empty(len(row))
                for a in range(0, len(row), 200_000):
                    some = slice(a, a + 200_000)
                    more[some] = (asked[tile, start:cut][row[some]] * turned[:, start:cut][col[some]]).sum(axis=1)
                value = value + more
                if cut < dim:
                    keep = seen_q[tile, cut - 1][row] + seen_x[col, cut - 1] - 2 * value <= limit * allowed + slack
                    row, col, value, allowed = row[keep], col[keep], value[keep], allowed[keep]
            start = cut
        pairs, through = pairs + own.size, through + len(row)
        keep = value >= bar[row]
        row, col = row[keep], col[keep]
        score = np.empty(len(row))
        for a in range(0, len(row), 200_000):
            some = slice(a, a + 200_000)
            score[some] = (q[tile][row[some]] * x[col[some]]).sum(axis=1)
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = place < k
        out.append((query_ids[tile][row[best]], ids[col[best]], score[best]))
    return [np.concatenate(c) for c in zip(*out)], pairs, through


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = K,
    probed_share: float = PROBED_SHARE,
    rejected: float = REJECTED,
    step: int = COLUMNS_PER_STEP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that the condition ``queries`` names.

    Candidates are all usable rows but the query's own; with fewer than k, all are returned. Nearest first,
    equal scores by smaller vec_id. ``score`` is the inner product of the original vectors in double
    precision. What takes no part is said in ``usable``; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    array = vectors.schema["embedding"].dataType.simpleString()  # components as given, not narrowed on the way
    rows = cut_lineage(usable(vectors))
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, total = dims["dim"], dims["count"]
    rows = rows.filter(F.col("dim") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE_ROWS).select("embedding").toPandas()
    lists = int(max(1, min(MOST_LISTS, len(sample), np.sqrt(total) / 2)))
    fitted = spark.sparkContext.broadcast((_kmeans(_matrix(sample["embedding"]), lists), _rotation(dim)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = fitted.value[0]
        for frame in frames:
            if len(frame):
                frame["list"] = np.argmax(_matrix(frame["embedding"]) @ centres.T, axis=1).astype(np.int32)
                yield frame

    listed = cut_lineage(
        rows.select("vec_id", "embedding", queries.alias("asks")).mapInPandas(
            assign, f"vec_id bigint, embedding {array}, asks boolean, list int"
        )
    )
    sizes = np.zeros(lists, np.int64)  # a number per list
    for r in listed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))
    shards = int(max(1, -(-listed.filter("asks").count() // SHARD_ROWS)))
    need = max(int(np.ceil(probed_share * total)), min(total, 4 * k))

    def probing(first: bool):
        """Deals queries (vec_id, embedding, shard, bound) to the lists they meet first, or to the others they probe."""

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = fitted.value[0]
            for frame in frames:
                for lo in range(0, len(frame), 512):
                    part = frame.iloc[lo : lo + 512]
                    order = np.argsort(-(_matrix(part["embedding"]) @ centres.T), axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    near = before <= k  # one more than k, for the query may be in it
                    take = (near if first else (before < need) & ~near) & (sizes[order] > 0)
                    who, at = np.nonzero(take)
                    chosen = order[who, at]
                    again = blocks[chosen]
                    who, chosen = np.repeat(who, again), np.repeat(chosen, again)
                    block = np.arange(len(who)) - np.repeat(np.cumsum(again) - again, again)
                    yield pd.DataFrame(
                        {
                            "query_id": part["vec_id"].to_numpy()[who],
                            "embedding": part["embedding"].to_numpy()[who],
                            "bound": part["bound"].to_numpy()[who],
                            "list": chosen.astype(np.int32),
                            "block": block.astype(np.int32),
                            "shard": part["shard"].to_numpy()[who],
                        }
                    )

        return probe

    shard = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(shards)).cast("int")
    queries_of = listed.filter("asks").select("vec_id", "embedding", shard.alias("shard"))
    dealt = f"query_id bigint, embedding {array}, bound double, list int, block int, shard int"
    per_list = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)
    held = listed.select(
        "vec_id",
        "embedding",
        "list",
        F.pmod(F.xxhash64("vec_id", F.lit(13)), per_list).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = _scan(
            right["vec_id"].to_numpy(),
            _matrix(right["embedding"]),
            left["query_id"].to_numpy(),
            _matrix(left["embedding"]),
            left["bound"].to_numpy(),
            fitted.value[1],
            k,
            rejected,
            step,
        )[0]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["list", "block", "shard"]
    scanned = "query_id bigint, vec_id bigint, score double"

    def met(asked: DataFrame) -> DataFrame:
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, scanned)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unbound = queries_of.withColumn("bound", F.lit(float("-inf")))
    near = cut_lineage(met(unbound.mapInPandas(probing(True), dealt)))
    kth = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = queries_of.join(kth, "vec_id", "left").select(
        "vec_id", "embedding", "shard", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")
    )
    found = near.unionByName(met(bounded.mapInPandas(probing(False), dealt)))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
