"""SentencePiece encoding and decoding: sampled segmentations by forward filtering, backward sampling.

The lattice of a text has an edge for every vocabulary piece that matches at a place; a character that
no piece spells has one edge of its UTF-8 byte pieces. A segmentation's weight is the product of its
pieces' weights, 1 / (rank + 2) by place in the vocabulary, to the power ``sharpness`` (the vocabulary
itself is of merge ranks and holds no probabilities). Forward sums over the lattice and a backward draw
give each segmentation with exactly its share of the total weight.

No piece has a blank after another character, and none crosses a line end or the place between a Latin
letter and a full stop or comma (checked when the vocabulary is opened), so the lattice falls apart into
units there. A unit's forward sums are computed once per worker and kept; the backward draws run for all
units of a batch together. Each draw is a hash of seed, row key, unit and step, so a row has the same
segmentation in whatever task or batch it is encoded.

Blanks are spelt by the vocabulary's blank sign; a blank sign in the text itself goes by bytes. No
normalisation is applied, so decoding gives back the text exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import groups, held

BLANK = "▁"
SHARPNESS = 1.0
SEED = 42
#: Lattice edges that a worker keeps before it starts anew: at 9 bytes each, with the units' names, some 80 MB.
KEPT_EDGES = 4_000_000
#: Bytes of text that are cut and drawn together; the draws take some 60 bytes of memory for each.
GROUP_CHARS = 600_000
#: Units up to this length are learned together; 48 weights of at least 1/32,000 are still far from zero.
MATRIX_CHARS = 48
_KEY_BASE = np.uint64(0x100000001B3)
_MARK = "\x1f"
#: The same units as the marked cut, but for empty ones, for texts that hold the mark themselves.
_UNIT = re.compile(" +[^ \n]*?(?:(?<=[A-Za-zÀ-ÿ])(?=[.,])|(?=[ \n]|$))|\n|[^ \n]+?(?:(?<=[A-Za-zÀ-ÿ])(?=[.,])|(?=[ \n]|$))")


class Lattice:
    """Vocabulary, kept units, sampling and decoding."""

    def __init__(self, path: str, sharpness: float = SHARPNESS, kept: int = KEPT_EDGES):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.size = sp.get_piece_size()
        self.byte_ids, self.spelling, ranked = [0] * 256, [b""] * size, []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.spelling[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ranked.append((piece.replace(BLANK, " "), i))
                self.spelling[i] = ranked[-1][0].encode("utf-8")
        self.weight = {p: (i, (n + 2.0) ** -sharpness) for n, (p, i) in enumerate(ranked)}
        self.longest = max(len(p) for p in self.weight)
        self.byte_weight = (len(ranked) + 2.0) ** -sharpness
        crossing = re.compile("[^ ] |\n|[A-Za-zÀ-ÿ][.,]")
        if any(crossing.search(p) and p.strip("\n") for p in self.weight):
            raise ValueError(f"{path} has pieces across blanks, line ends or word ends; units cannot be cut there")
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in self.weight]
        keys = np.array([_spelling_key(c[None, :])[0] for c in codes], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError(f"{path} has pieces with equal keys")
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ids = np.array([i for i, _ in self.weight.values()], np.int32)[order]
        self.key_weights = np.array([w for _, w in self.weight.values()])[order]
        self.kept = kept
        self.start, self.chars = _Column("int32", kept // 16), _Column("int32", kept // 16)  # per unit: first node, length
        self.first = _Column("int32", kept // 2)  # per node: its first edge
        self.share, self.back, self.piece = (_Column(t, kept) for t in ("float32", "uint8", "int32"))  # per edge
        self.clear()

    def clear(self) -> None:
        self.units = {"": 0}
        columns = [self.start, self.chars, self.first, self.share, self.back, self.piece]
        for column in columns:
            column.size = 0
        self.start.extend([0])
        self.chars.extend([0])

    def learn(self, units: list[str]) -> None:
        """Forward sums over new units: for every end, the shares of the edges that come in there."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for n, group in sorted(by_length.items()):
            size = max(1, 30_000 // n)
            for lo in range(0, len(group), size):
                if n <= MATRIX_CHARS:
                    self._learn_matrix(group[lo : lo + size], n)
                else:
                    for u in group[lo : lo + size]:
                        self._learn_long(u)

    def _learn_matrix(self, units: list[str], n: int) -> None:
        """Units of one length together: piece look-ups by rolling keys, sums column by column."""
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(len(units), n)
        most = min(n, self.longest)
        weight = np.zeros((len(units), n, most))  # by unit, end - 1, length - 1
        piece = np.zeros((len(units), n, most), np.int32)
        key = np.zeros((len(units), n), np.uint64)
        for size in range(1, most + 1):
            key = key[:, : n - size + 1] * _KEY_BASE + chars[:, size - 1 :].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            weight[:, size - 1 :, size - 1] = np.where(hit, self.key_weights[at], 0.0)
            piece[:, size - 1 :, size - 1] = self.key_ids[at]
        bare = weight[:, :, 0] == 0
        weight[:, :, 0][bare] = self.byte_weight
        piece[:, :, 0][bare] = self.size + chars[bare].astype(np.int32)
        alpha = np.zeros((len(units), n + 1))
        alpha[:, 0] = 1.0
        for end in range(1, n + 1):
            for size in range(1, min(end, most) + 1):
                weight[:, end - 1, size - 1] *= alpha[:, end - size]
                alpha[:, end] += weight[:, end - 1, size - 1]
        order = np.argsort(-weight, axis=2, kind="stable")
        weight = np.take_along_axis(weight, order, 2)
        shares = np.cumsum(weight, axis=2) / alpha[:, 1:, None]
        there = weight > 0
        counts = there.sum(axis=2)
        shares[np.arange(len(units))[:, None], np.arange(n)[None, :], counts - 1] = 2.0
        for number, u in enumerate(units, len(self.start)):
            self.units[u] = number
        self.start.extend(len(self.first) + n * np.arange(len(units)))
        self.chars.extend(np.full(len(units), n))
        ends = np.cumsum(counts.ravel())
        self.first.extend(len(self.share) + np.concatenate(([0], ends[:-1])))
        self.share.extend(shares[there])
        self.back.extend(order[there] + 1)
        self.piece.extend(np.take_along_axis(piece, order, 2)[there])

    def _learn_long(self, unit: str) -> None:
        """The same for one long unit, with the sums scaled so that they never vanish."""
        n, get, longest = len(unit), self.weight.get, self.longest
        alpha = [0.0] * (n + 1)
        alpha[0] = 1.0
        self.units[unit] = len(self.start)
        self.start.extend([len(self.first)])
        self.chars.extend([n])
        first, share, backs, pieces = [], [], [], []
        for j in range(1, n + 1):
            edges = []
            for i in range(max(0, j - longest), j):
                found = get(unit[i:j])
                if found:
                    edges.append((alpha[i] * found[1], j - i, found[0]))
            if unit[j - 1] not in self.weight:
                edges.append((alpha[j - 1] * self.byte_weight, 1, self.size + ord(unit[j - 1])))
            edges.sort(reverse=True)
            total = sum(e[0] for e in edges)
            if total < 1e-200:
                for i in range(max(0, j - longest), j):
                    alpha[i] *= 1e200
                edges = [(w * 1e200, b, p) for w, b, p in edges]
                total *= 1e200
            alpha[j] = total
            first.append(len(self.share) + len(share))
            up = 0.0
            for w, back, piece in edges:
                up += w / total
                share.append(up)
                backs.append(back)
                pieces.append(piece)
            share[-1] = 2.0
        self.first.extend(first)
        self.share.extend(share)
        self.back.extend(backs)
        self.piece.extend(pieces)

    def _cut(self, texts: list[str]):
        """(offsets per text, unit numbers): texts cut into units, a list array by Arrow's own functions."""
        # A text that holds the mark is cut in Python, always and alone: its units never depend on its neighbours.
        odd = [i for i, t in enumerate(texts) if _MARK in t]
        mark = _MARK
        made = pa.array(texts, pa.large_string())
        made = pc.replace_substring_regex(made, "( +)", mark + "\\1")
        made = pc.replace_substring(made, "\n", f"{mark}\n{mark}")
        made = pc.replace_substring_regex(made, "([A-Za-zÀ-ÿ])([.,])", f"\\1{mark}\\2")
        lists = pc.split_pattern(made, mark)
        if odd:
            units = lists.to_pylist()
            for i in odd:
                units[i] = _UNIT.findall(texts[i])
            lists = pa.array(units, pa.large_list(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.share) > self.kept:
            self.clear()
        self.learn([n for n in names if n not in self.units])
        numbers = np.array([self.units[n] for n in names], np.int64)
        return lists.offsets.to_numpy(), numbers[coded.indices.to_numpy()] if names else np.empty(0, np.int64)

    def sample(self, texts: list[str | None], seeds: list[int]):
        """(offsets, ids): sampled piece ids of the texts, one after another."""
        offsets, units = self._cut([t or "" for t in texts])
        counts = np.diff(offsets)
        seed = np.repeat(np.array(seeds, np.uint64), counts)
        place = np.arange(len(units), dtype=np.uint64) - np.repeat(offsets[:-1].astype(np.uint64), counts)
        seed = _mixed(seed ^ _mixed(place + np.uint64(0x9E3779B97F4A7C15)))
        start, chars, first = self.start.rows(), self.chars.rows(), self.first.rows()
        share, back, piece = self.share.rows(), self.back.rows(), self.piece.rows()
        who, left, steps, step = np.arange(len(units)), chars[units].astype(np.int64), [], 0
        who, left = who[left > 0], left[left > 0]
        node = start[units[who]] - 1
        while len(who):
            draw = (_mixed(seed[who] + np.uint64(step)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            edge = first[node + left]
            more = np.flatnonzero(draw >= share[edge])
            while len(more):
                edge[more] += 1
                more = more[draw[more] >= share[edge[more]]]
            steps.append((who, piece[edge]))
            left = left - back[edge]
            go = left > 0
            who, left, node, step = who[go], left[go], node[go], step + 1
        width = np.zeros(len(units), np.int64)
        lengths = []
        for who, ids in steps:
            length = np.ones(len(ids), np.int64)
            code = ids - self.size
            length[code >= 0] = 1 + (code[code >= 0] > 0x7F) + (code[code >= 0] > 0x7FF) + (code[code >= 0] > 0xFFFF)
            lengths.append(length)
            width[who] += length
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        at = ends.copy()
        for (who, ids), length in zip(steps, lengths):
            at[who] -= length
            plain = ids < self.size
            out[at[who[plain]]] = ids[plain]
            for w, code in zip(who[~plain], ids[~plain] - self.size):
                spelt = [self.byte_ids[b] for b in chr(code).encode("utf-8")]
                out[at[w] : at[w] + len(spelt)] = spelt
        bounds = np.concatenate(([0], ends))[offsets]
        return bounds, out

    def text_of(self, ids) -> str:
        spelling = self.spelling
        return b"".join([spelling[i] for i in ids]).decode("utf-8")


class _Column:
    """A typed column that grows."""

    def __init__(self, kind: str, room: int):
        self.data, self.size = np.empty(room + 1024, kind), 0

    def __len__(self) -> int:
        return self.size

    def extend(self, rows) -> None:
        end = self.size + len(rows)
        if end > len(self.data):
            grown = np.empty(end * 5 // 4, self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : end] = rows
        self.size = end

    def rows(self):
        return self.data[: self.size]


def _spelling_key(codes):
    """The rolling key of rows of code points, as the matrix look-up makes it step by step."""
    key = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        key = key * _KEY_BASE + column.astype(np.uint64) + np.uint64(1)
    return key


def _mixed(x):
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lattice(path: str, sharpness: float = SHARPNESS) -> Lattice:
    return held(("lattice", path, sharpness), lambda: Lattice(path, sharpness))


def sampled(key: Column, text: Column, path: str, seed: int = SEED, sharpness: float = SHARPNESS) -> Column:
    """ARRAY<INT> of sampled piece ids of ``text``, seeded by ``seed`` and the row's ``key``.

    Null and empty texts have no pieces. A null key is a key of its own. Rows with equal key and text get
    equal pieces; rows with one text under several keys are drawn independently.
    """

    @F.arrow_udf("array<int>")
    def drawn(seeds: pa.Array, texts: pa.Array) -> pa.Array:
        own, made = lattice(path, sharpness), [pa.array([], pa.list_(pa.int32()))]
        for part in groups(texts, GROUP_CHARS):
            bounds, ids = own.sample(
                texts.slice(*part).to_pylist(), [s & (2**64 - 1) for s in seeds.slice(*part).to_pylist()]
            )
            made.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
        return pa.concat_arrays(made)

    return drawn(F.xxhash64(F.lit(seed), key.cast("string")), text)


def decoded(ids: Column, path: str) -> Column:
    """The text that piece ids spell; null and empty lists are the empty text."""

    @F.arrow_udf("string")
    def spelt(lists: pa.Array) -> pa.Array:
        own = lattice(path)
        return pa.array([own.text_of(i.values.to_pylist() if i.is_valid else ()) for i in lists], pa.string())

    return spelt(ids)


def encoded(text: Column, path: str) -> Column:
    """ARRAY<INT> of the library's own best segmentation (with its normalisation); null is empty."""

    @F.arrow_udf("array<int>")
    def best(texts: pa.Array) -> pa.Array:
        own = lattice(path).library
        return pa.array([own.encode(t or "", num_threads=1) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return best(text)


def _parts(batches, path: str, sharpness: float, key: int, text: int):
    """Slices of record batches with their sampled pieces, small enough to be held beside the units."""
    own = lattice(path, sharpness)
    for batch in batches:
        for part in groups(batch.column(text), GROUP_CHARS):
            some = batch.slice(*part)
            seeds = [s & (2**64 - 1) for s in some.column(key).to_pylist()]
            bounds, ids = own.sample(some.column(text).to_pylist(), seeds)
            yield some, bounds, ids


def _row_seed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))


def with_pieces(
    docs: DataFrame, path: str, seed: int = SEED, sharpness: float = SHARPNESS, column: str = "piece_ids"
) -> DataFrame:
    """``docs`` with the sampled pieces of ``text``, seeded by doc_id, as the column named ``column``.

    Every row stays, repeated rows too. A column of that name that is there already is replaced.
    """
    kept = docs.drop(column)
    text, width = kept.columns.index("text"), len(kept.columns)
    schema = StructType([*kept.schema.fields, StructField(column, ArrayType(IntegerType()))])

    def cut(batches):
        for some, bounds, ids in _parts(batches, path, sharpness, width, text):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*some.columns[:width], lists], names=[*some.schema.names[:width], column])

    names = [F.col(f"`{c}`") for c in kept.columns]
    return kept.select(*names, _row_seed(seed).alias("row seed")).mapInArrow(cut, schema)


def sampled_digests(docs: DataFrame, path: str, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_crc32, text_sha256, lossless) per row of ``docs`` (doc_id, text).

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``text_sha256`` is that of
    the decoded text, and ``lossless`` says that it equals the text (null: the empty text).
    """

    def digested(batches):
        import hashlib
        import zlib

        own = lattice(path, sharpness)
        for some, bounds, ids in _parts(batches, path, sharpness, 1, 2):
            chars, counts, sums, hashes, same = [], np.diff(bounds), [], [], []
            for first, last, text in zip(bounds[:-1].tolist(), bounds[1:].tolist(), some.column(2).to_pylist()):
                back = own.text_of(ids[first:last].tolist())
                chars.append(len(text or ""))
                sums.append(zlib.crc32(ids[first:last].astype("<u4").tobytes()))
                hashes.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                same.append(back == (text or ""))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(chars, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(hashes), pa.array(same)],
                names=["doc_id", "n_chars", "n_pieces", "ids_crc32", "text_sha256", "lossless"],
            )

    schema = StructType(
        [
            docs.schema["doc_id"],
            *(StructField(n, LongType()) for n in ("n_chars", "n_pieces", "ids_crc32")),
            StructField("text_sha256", StringType()),
            StructField("lossless", BooleanType()),
        ]
    )
    return docs.select("doc_id", _row_seed(seed).alias("seed"), "text").mapInArrow(digested, schema)
