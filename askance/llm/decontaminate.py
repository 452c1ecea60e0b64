"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, scanned over documents.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). A
document is scanned in strides: a window of n words that occurs covers at least one document position
that is a multiple of n - ANCHOR + 1, and the ANCHOR words there are looked up in the set of the
benchmark's ANCHOR-grams. Only around such a hit are the whole windows compared, word by word, so
every hit is verified and none is missed.

The broadcast is bounded: windows are dealt into slices of at most ``SLICE_WINDOWS``, each slice is
broadcast by itself and scanned in its own pass, and the passes' hits meet per document. A benchmark
of usual size is one slice and needs no shuffle at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
ANCHOR = 4
#: Windows in one broadcast: 200,000 windows of 13 words are about 20 MB.
SLICE_WINDOWS = 200_000

_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FOUND = "n_words bigint, hits array<struct<item_id: string, first: int, last: int>>"
_DIGEST = "n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_WORD).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class WindowSet:
    """Windows by their words, each with the ids of its items; by length, with the anchors of each."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.items: dict[bytes, tuple[str, ...]] = {}
        self.lengths: dict[int, tuple[int, int, frozenset[bytes]]] = {}
        anchors: dict[int, set[bytes]] = {}
        for item, joined in rows:
            if item not in self.items.get(joined, ()):
                self.items[joined] = (*self.items.get(joined, ()), item)
            words = joined.split(b" ")
            size = min(ANCHOR, len(words))
            anchors.setdefault(len(words), set()).update(
                b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)
            )
        for n, grams in anchors.items():
            size = min(ANCHOR, n)
            self.lengths[n] = (size, n - size + 1, frozenset(grams))

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(item, first word, word after the last) of every occurrence of every window."""
        found, total = [], len(words)
        for n, (size, stride, grams) in self.lengths.items():
            seen_to = 0
            for at in range(0, total - size + 1, stride):
                if b" ".join(words[at : at + size]) in grams:
                    for start in range(max(seen_to, at + size - n), min(at, total - n) + 1):
                        for item in self.items.get(b" ".join(words[start : start + n]), ()):
                            found.append((item, start, start + n))
                    seen_to = max(seen_to, at + 1)
        return found


def merged(hits: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Occurrences of one item that overlap or touch, as one run of words."""
    out: list[tuple[str, int, int]] = []
    for item, first, last in sorted(hits):
        if out and out[-1][0] == item and first <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(out[-1][2], last))
        else:
            out.append((item, first, last))
    return out


def covered(hits) -> int:
    """Words inside any run."""
    count, end = 0, 0
    for first, last in sorted((f, t) for _, f, t in hits):
        count += max(0, last - max(first, end))
        end = max(end, last)
    return count


def window_rows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id as string, joined words) of a benchmark (item_id, text)."""

    @F.pandas_udf("array<string>")
    def unfolded(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({b" ".join(w).decode() for w in windows_of(t, window)}) for t in texts])

    return (
        bench.filter(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("string").alias("item_id"), F.explode(unfolded("text")).alias("gram"))
        .distinct()
    )


def _slices(grams: DataFrame, most: int) -> list:
    """Broadcasts of about ``most`` windows each at the most, dealt by hash."""
    spark = grams.sparkSession
    parts = max(1, -(-grams.count() // most))
    out = []
    for k in range(parts):
        part = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).collect()
        out.append(spark.sparkContext.broadcast([(r.item_id, r.gram.encode()) for r in part]))
    return out


def _scanner(text: Column, rows) -> Column:
    """Number of words and merged runs of one slice's windows, per text."""

    @F.pandas_udf(_FOUND)
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = WindowSet(rows.value)
        for texts in parts:
            found = []
            for text in texts:
                words = words_of(text)
                runs = merged(windows.scan(words))
                found.append((len(words), [{"item_id": i, "first": a, "last": b} for i, a, b in runs]))
            yield pd.DataFrame(found, columns=["n_words", "hits"])

    return scanned(text)


def _digests(n_words: Column, hits: Column) -> Column:
    @F.pandas_udf(_DIGEST)
    def digested(counts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for n, runs in zip(counts, found):
            runs = [(r["item_id"], r["first"], r["last"]) for r in runs] if runs is not None else []
            hit, items = covered(runs), sorted({r[0] for r in runs})
            digest = hashlib.sha256(",".join(items).encode()).hexdigest()
            rows.append((hit, len(items), digest, hit > 0 and 20 * hit >= n))
        return pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256", "contaminated"])

    return digested(n_words, hits)


def contamination(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, slice_windows: int = SLICE_WINDOWS
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, hits, n_hit, n_items, items_sha256, contaminated.

    ``hits`` are the runs of words (first, last exclusive) that each benchmark item covers. A document is
    contaminated if a word is hit and the hit words are at least a twentieth of its words. Null, empty and
    wordless texts have no words and no hits; benchmark items without words or without an id have no
    windows; items given twice count once. Repeated documents come out as often as they came in. An empty
    benchmark leaves every document clean. Other columns are not looked at.
    """
    found = _found(docs, _slices(window_rows(bench, window), slice_windows))
    digest = _digests(F.col("n_words"), F.col("hits")).alias("d")
    return found.select("doc_id", "n_words", "hits", digest).select(
        "doc_id", "n_words", "hits", "d.n_hit", "d.n_items", "d.items_sha256", "d.contaminated"
    )


def _found(docs: DataFrame, slices: list) -> DataFrame:
    """(doc_id, text_key, n_words, hits) per row; one pass over the texts for each slice."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key")
    if len(slices) == 1:
        return docs.select("doc_id", key, _scanner(F.col("text"), slices[0]).alias("f")).select("doc_id", "text_key", "f.*")
    passes = None
    for rows in slices:
        one = docs.select(F.col("doc_id").alias("id"), key.alias("key"), _scanner(F.col("text"), rows).alias("f"))
        one = one.select("id", "key", F.explode("f.hits").alias("hit")).distinct()
        passes = one if passes is None else passes.unionByName(one)
    hits = passes.groupBy("id", "key").agg(F.collect_set("hit").alias("hits"))
    counted = docs.select("doc_id", key, _counted(F.col("text")).alias("n_words"))
    met = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    return met.select("doc_id", "text_key", "n_words", F.coalesce("hits", F.array()).alias("hits"))


def _counted(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    return counted(text)


def remove_contaminated(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, slice_windows: int = SLICE_WINDOWS
) -> DataFrame:
    """``docs`` without its contaminated documents; the rows that stay are unchanged."""
    slices = _slices(window_rows(bench, window), slice_windows)
    if len(slices) == 1:
        found = _scanner(F.col("text"), slices[0])
        return docs.filter(~_digests(found["n_words"], found["hits"])["contaminated"])
    found = _found(docs, slices).withColumn("d", _digests(F.col("n_words"), F.col("hits")))
    gone = found.filter("d.contaminated").select("doc_id", "text_key").distinct().alias("gone")
    same = F.col("docs.doc_id").eqNullSafe(F.col("gone.doc_id"))
    same &= F.sha2(F.coalesce("docs.text", F.lit("")), 256) == F.col("gone.text_key")
    return docs.alias("docs").join(gone, same, "left_anti").select([F.col(f"docs.`{c}`") for c in docs.columns])
