"""SimHash near-duplicates through an inverted index on fingerprint bytes, with count filtering.

Two 64-bit fingerprints that differ in at most ``MAX_BITS`` = 2 bits differ in at most two of their
eight bytes, so every linked pair is guaranteed ``NEEDED`` = 6 matches of (position, byte). Two
differing bytes touch at most two of the four pairs of neighbouring positions, so a linked pair also
agrees on two of these pairs: the index holds a posting list per choice of two (six choices) and
their four bytes. Inside a list the bytes that two members share are tallied, pairs reaching six are
kept and then verified bit by bit; all this happens in arrays, and only a spanning forest of the
verified links leaves the task, never a row per pair.

A list of more than ``LISTED`` fingerprints is dealt out anew by two more of its positions (six
choices again). Its sublists agree on six bytes, so their pairs reach the count by their key; they hold
at most 2^16 members, and links are verified by looking up the values at distance one and two.
Nothing is cut: a pair of a long list with six shared bytes meets in at least one sublist.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

BYTES = 8
MAX_BITS = 2
SHINGLE = 3
SEED = 42
#: Positions at which a linked pair surely shares its byte.
NEEDED = BYTES - MAX_BITS
#: The four positions of each posting list, and the six of each of its sublists.
POSTED = tuple(a + b for a, b in combinations([(p, p + 1) for p in range(0, BYTES, 2)], 2))
SUBLISTS = tuple(
    tuple(tuple(sorted(kept + more)) for more in combinations(sorted(set(range(BYTES)) - set(kept)), 2)) for kept in POSTED
)
#: Longer lists are dealt out by two more positions, so the pairs tallied in one list stay few.
LISTED = 2_048


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text; 0 for a text without words. Signed, as Spark's BIGINT."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, ends, at = b" ".join(words), [], 0
        for w in words:
            at += len(w) + 1
            ends.append(at - 1)
        starts = [0] + [e + 1 for e in ends[: -SHINGLE]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])]
    n, ones = len(hashes), np.zeros(64, np.int64)
    packed = np.array(hashes, dtype=">u8")
    for lo in range(0, n, 65_536):
        bits = np.unpackbits(packed[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint(text: Column) -> Column:
    """BIGINT fingerprint of a text column (null and wordless texts: 0)."""

    @F.pandas_udf("bigint")
    def hashed(texts):
        import pandas as pd

        return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return hashed(text)


def _posting(fp: Column, kept: tuple[int, ...], number: int) -> Column:
    """The bytes at the kept positions, and above them which list it is."""
    key = F.lit(number << (8 * len(kept))).cast("bigint")
    for n, p in enumerate(kept):
        byte = F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("bigint"))
        key = key.bitwiseOR(F.shiftleft(byte, 8 * n))
    return key


def _tallied(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within each list; rows are sorted by list.

    Step by step each member meets the one so many places on in its list, for all lists at once.
    """
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    end = np.repeat(np.append(first[1:], len(keys)), np.diff(np.append(first, len(keys))))
    values, up, edges = fps.view(np.uint64), list(range(len(fps))), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    at, step = np.arange(len(fps)), 1
    while len(at := at[at + step < end[at]]):
        differ = values[at] ^ values[at + step]
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        reached = shared >= NEEDED
        linked = np.bitwise_count(differ[reached]) <= MAX_BITS
        for i in at[reached][linked].tolist():
            a, b = find(i), find(i + step)
            if a != b:
                up[b] = a
                edges.append((int(fps[i]), int(fps[i + step])))
        step += 1
    return edges


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what lies within two bits of each other among members of one sublist."""
    if len(members) == 2:
        a, b = int(members[0]), int(members[1])
        return [(a, b)] if bin((a ^ b) & (2**64 - 1)).count("1") <= MAX_BITS else []
    values = {int(m) & (2**64 - 1): int(m) for m in members}
    first = next(iter(values))
    spread = 0
    for v in values:
        spread |= v ^ first
    bits = [1 << b for b in range(64) if spread >> b & 1]
    flips = bits + [a | b for a, b in combinations(bits, 2)]
    todo, edges = set(values), []
    if len(flips) >= len(values):
        while todo:
            stack = [todo.pop()]
            while stack:
                here = stack.pop()
                near = [v for v in todo if bin(v ^ here).count("1") <= MAX_BITS]
                todo.difference_update(near)
                edges += [(values[here], values[v]) for v in near]
                stack += near
        return edges
    while todo:
        stack = [todo.pop()]
        while stack:
            here = stack.pop()
            for flip in flips:
                v = here ^ flip
                if v in todo:
                    todo.discard(v)
                    edges.append((values[here], values[v]))
                    stack.append(v)
    return edges


def _lists(batches):
    """Whole lists of sorted (list, fingerprint) batches, many short ones together; a list may span batches."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
        if cut:
            yield keys[:cut], fps[:cut]
        held_k, held_f = keys[cut:], fps[cut:]
    if len(held_k):
        yield held_k, held_f


def _rows(a, b, more=None):
    import pyarrow as pa

    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    names = ["a", "b"]
    if more is not None:
        columns.append(pa.array(more, pa.int64()))
        names.append("more")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _edges(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs.min(1), pairs.max(1)


def _links(batches, listed: int):
    """Links (a, b, null) of short lists; members (fingerprint, null, list) of lists longer than ``listed``.

    A long list passes through batch by batch: no more than ``listed`` of its members are ever held.
    """
    held_k, held_f, passing = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        keys = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(first, len(keys)))
        long = np.repeat((size > listed) | (keys[first] == passing), size)
        last = int(first[-1])
        if long.any():
            yield _rows(fps[long], np.ma.masked_all(int(long.sum()), np.int64), keys[long])
        done = ~long
        done[last:] = False
        if done.any():
            a, b = _edges(_tallied(keys[done], fps[done]))
            yield _rows(a, b, np.ma.masked_all(len(a), np.int64))
        passing = keys[-1] if long[-1] else None
        held_k, held_f = (keys[:0], fps[:0]) if long[-1] else (keys[last:], fps[last:])
    if len(held_k):
        a, b = _edges(_tallied(held_k, held_f))
        yield _rows(a, b, np.ma.masked_all(len(a), np.int64))


def _sublinks(batches):
    """Links (a, b) inside sublists, at most 2^16 members each."""
    for keys, fps in _lists(batches):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        found = []
        for lo, hi in zip(first[:-1], first[1:]):
            members = np.unique(fps[lo:hi])  # a sublist may be reached from several lists
            if len(members) > 1:
                found += _forest(members)
        yield _rows(*_edges(found))


def links(fingerprints: DataFrame, listed: int = LISTED) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct values of ``fingerprint``.

    ``listed``: the longest list tallied as a whole; it changes the work, never the links.
    """
    fp = F.col("fingerprint")
    keys = F.array(*[_posting(fp, kept, n) for n, kept in enumerate(POSTED)])
    keyed = fingerprints.select(F.explode(keys).alias("key"), "fingerprint")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fingerprint")
    met = cut_lineage(dealt.mapInArrow(partial(_links, listed=listed), "a bigint, b bigint, more bigint"))
    numbers = {kept: n for n, kept in enumerate(dict.fromkeys(k for many in SUBLISTS for k in many))}
    deeper = F.element_at(
        F.array(*[F.array(*[_posting(F.col("a"), kept, numbers[kept]) for kept in many]) for many in SUBLISTS]),
        (F.shiftright("more", 8 * len(POSTED[0])) + 1).cast("int"),
    )
    rest = met.filter("b is null").select(F.explode(deeper).alias("key"), F.col("a").alias("fingerprint"))
    again = rest.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(_sublinks, "a bigint, b bigint")
    return met.filter("b is not null").select("a", "b").unionByName(again).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds: every node hands its larger, then its smaller
    neighbours to the smallest neighbour. Each half round is one grouped minimum and one join, and is
    written to the shared folder, so a lost executor costs a re-read and not a re-run.
    """

    def star(table: DataFrame, large: bool) -> DataFrame:
        both = table.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(table.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(lowest, "u")
        if large:
            out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return cut_lineage(out.filter("a <> b").distinct())

    def mark(table: DataFrame):
        return table.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))
        ).first()

    edges = cut_lineage(edges.select("a", "b"))
    last, now = None, mark(edges)
    while now[0] and now != last:
        edges = star(star(edges, large=True), large=False)
        last, now = now, mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id among the rows
    whose fingerprints can be reached over links of at most two bits, itself included. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Repeated rows come out as often
    as they came in. A null doc_id is never a component's id unless nothing else is in it. An empty
    table gives an empty result; columns other than doc_id and text are not looked at.
    """
    hashed = cut_lineage(docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint")))
    distinct = cut_lineage(hashed.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")))
    roots = components(links(distinct.select("fingerprint")))
    grouped = distinct.join(
        roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    least = grouped.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = cut_lineage(grouped.join(least, "root").select("fingerprint", "component_id"))
    return hashed.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Rows are judged by doc_id and text: rows that share a doc_id with unlike texts are documents of their
    own, and of a group's rows with its smallest doc_id that of the least hash stays, once. Rows without a
    doc_id link like others, but only those of a group without one stand for each other: besides the named
    document, one of them stays. Columns are those of ``docs``, in their order, whatever their names.
    """
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("text", F.lit(""))), 256)
    hashed = docs.select("doc_id", key.alias("key"), fingerprint(F.col("text")).alias("fingerprint"))
    best = F.min(F.struct("doc_id", "key")).alias("best")
    distinct = cut_lineage(hashed.groupBy("fingerprint", F.col("doc_id").isNull().alias("unnamed")).agg(best))
    roots = components(links(distinct.select("fingerprint").distinct()))
    kept = (
        distinct.join(roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left")
        .groupBy(F.coalesce("root", "fingerprint").alias("root"), "unnamed")
        .agg(F.min("best").alias("best"))
        .select("best.key")
    )
    comparable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(
        key.alias("key"), F.xxhash64(*comparable).alias("order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    one = rows.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", "order").alias("row"))
    return one.select("row.*")
