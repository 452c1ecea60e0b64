"""Fill-in-middle: texts cut in three at places found by a learned rank index.

The boundaries of a text's units (code points, words or lines) are byte offsets in its UTF-8. A piecewise-linear
index learns the map from a boundary's rank to its offset: a segment grows while one slope keeps every boundary
within ``ERROR_BOUND`` bytes, and what the line misses is stored per boundary in one signed byte. A cut's offset is
the line's value at its rank, corrected by the stored residual: exact, whatever the text. Texts of one byte a
character are a single segment without residuals.

Every row is decided alone, from its own id and text, so no row moves and a repeated task writes the same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of a hundred texts so many are cut, and of a hundred cut ones so many put the suffix first.
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: How far, in bytes, a segment may be from the boundaries it stands for; a residual fits a signed byte.
ERROR_BOUND = 120
UNITS = ("char", "word", "line")
_FIRST_STEP, _WIDEST_STEP = 1_024, 1 << 18


def boundaries(data: np.ndarray, unit: str = "char") -> np.ndarray:
    """Byte offsets where the units of ``data`` (UTF-8 as uint8) begin, and its length last.

    A word is a run of bytes other than blank, tab and line ends, with the white space after it; white space before
    the first word goes with it. A line ends behind its line feed. Empty texts have the one boundary 0.
    """
    if not len(data):
        return np.zeros(1, dtype=np.int64)
    if unit == "line":
        starts = np.append(0, np.flatnonzero(data[:-1] == 10) + 1)
    elif unit == "word":
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        starts = np.flatnonzero(np.append(True, blank[:-1]) & ~blank)
    else:
        starts = np.flatnonzero((data & 0xC0) != 0x80)
    # What stands before the first unit (white space, bytes that continue nothing) goes with it.
    starts = starts if len(starts) else np.zeros(1, dtype=np.int64)
    starts[0] = 0
    return np.concatenate([starts, [len(data)]]).astype(np.int64)


@dataclass(frozen=True)
class RankIndex:
    """Segments (first rank, its offset, slope) and a residual per boundary."""

    ranks: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def _line(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.ranks, rank, side="right") - 1
        return self.offsets[s] + np.floor(self.slopes[s] * (rank - self.ranks[s])).astype(np.int64)

    def offset(self, rank) -> np.ndarray:
        """The exact offsets of boundaries by their ranks."""
        rank = np.asarray(rank, dtype=np.int64)
        return self._line(rank) + self.residuals[rank]


def fit(offsets: np.ndarray, bound: int = ERROR_BOUND) -> RankIndex:
    """An index over all of ``offsets`` (ascending). A segment goes through its first boundary; it ends before the
    first boundary for which no slope is left that stays within ``bound`` of every boundary so far."""
    first, count, ranks, slopes = 0, len(offsets), [], []
    while first < count:
        at, step, low, high, end = first + 1, _FIRST_STEP, -np.inf, np.inf, count
        while at < count:
            to = min(count, at + step)
            run = np.arange(at - first, to - first, dtype=np.float64)
            rise = (offsets[at:to] - offsets[first]).astype(np.float64)
            lows = np.maximum(np.maximum.accumulate((rise - bound) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + bound) / run), high)
            closed = lows > highs
            if closed[-1]:
                stop = int(closed.argmax())
                if stop:
                    low, high = lows[stop - 1], highs[stop - 1]
                end = at + stop
                break
            low, high, at, step = lows[-1], highs[-1], to, min(step * 4, _WIDEST_STEP)
        ranks.append(first)
        slopes.append((low + high) / 2 if np.isfinite(low) else 0.0)
        first = end
    starts = np.array(ranks, dtype=np.int64)
    bare = RankIndex(starts, offsets[starts], np.array(slopes), np.zeros(0, dtype=np.int8))
    missed = offsets - bare._line(np.arange(count, dtype=np.int64))
    return RankIndex(bare.ranks, bare.offsets, bare.slopes, missed.astype(np.int8))


def _as_bytes(values: pa.Array) -> Iterator[bytes]:
    for v in values:
        yield v.as_py() or b""


_INDEX = "n_units bigint, segments array<struct<rank:bigint,offset:bigint,slope:double>>, residuals binary"


def rank_index(docs: DataFrame, unit: str = "char", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_units, segments, residuals): the stored index of each row's boundaries, ``n_units`` + 1 of them."""
    _known(unit)
    kind = docs.schema[key].dataType.simpleString()

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, segments, residuals = [], [], []
            for data in _as_bytes(part.column(1)):
                made = fit(boundaries(np.frombuffer(data, dtype=np.uint8), unit))
                counts.append(len(made.residuals) - 1)
                segments.append([
                    {"rank": int(r), "offset": int(o), "slope": float(s)}
                    for r, o, s in zip(made.ranks, made.offsets, made.slopes)
                ])
                residuals.append(made.residuals.tobytes())
            shape = pa.list_(pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(segments, shape), pa.array(residuals, pa.binary())],
                [part.schema.names[0], "n_units", "segments", "residuals"],
            )

    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(index, f"`{key}` {kind}, {_INDEX}")


def _known(unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; known: {', '.join(UNITS)}")


def _draws(key: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the row key: the first groups of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"_h{i + 1}") for i in range(4)]


_PARTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(
    docs: DataFrame, unit: str = "char", seed: int = SEED, cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) per row.

    ``n`` counts units; prefix and middle lengths are in units too and null where the form is plain. Both cuts are
    drawn from the key: 0..n each, the smaller first. ``plain`` are empty texts, texts that hold a mark, and the share
    that is not cut; ``spm`` puts the suffix first, ``psm`` the prefix. A null text is empty, a null key draws like an
    empty one. Repeated rows come out as often as they came in; other columns are not looked at.
    """
    _known(unit)
    kind = docs.schema[key].dataType.simpleString()
    p, s, m = (mark.encode() for mark in MARKS)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            draws = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)], axis=1)
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for data, (h1, h2, h3, h4) in zip(_as_bytes(part.column(1)), draws.tolist()):
                ends = boundaries(np.frombuffer(data, dtype=np.uint8), unit)
                n = len(ends) - 1
                counts.append(n)
                if not data or p in data or s in data or m in data or h3 % 100 >= cut_percent:
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(data)
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = fit(ends).offset([first, second]).tolist()
                prefix, middle, suffix = data[:a], data[a:b], data[b:]
                prefixes.append(first)
                middles.append(second - first)
                if h4 % 100 < suffix_first_percent:
                    forms.append("spm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle)))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((p, prefix, s, suffix, m, middle)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()),
                    pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                [part.schema.names[0], "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("_text"), *_draws(key, seed))
    return rows.mapInArrow(cut, f"`{key}` {kind}, {_PARTS}")


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. A cut text holds no mark, so each mark stands once."""
    parts = F.split(output, "<[PSM]>", -1)
    whole = F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
    whole = whole.when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
    return whole.otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``fill_in_middle`` by characters."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
