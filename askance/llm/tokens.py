"""Exact token ids and counts with a digest cache.

``TextEncoder`` is the per-worker helper that both token operators share: it encodes each distinct
white-space separated chunk once by the tokenizer library and joins the ids of a text from them. That
is exact for a tokenizer whose normaliser and pre-tokenizer work chunk by chunk; any other tokenizer,
and any text that holds the mark of a special token, is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, file_digest, groups, held

#: Chunks that a worker remembers in each of two generations: at some 170 bytes each 25 MB and 25 MB.
CACHED_CHUNKS = 150_000
#: Bytes of text that are encoded together.
GROUP_BYTES = 4_000_000
#: Normaliser steps that never look across a blank, once white space only separates.
_LOCAL_STEPS = {"NFC", "Lowercase"}


def _local_to_chunks(spec: dict) -> bool:
    """Whether white space is dropped by the pre-tokenizer and nothing else spans it."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    spaces = [s for s in steps if s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"}]
    others = [s for s in steps if s.get("type") not in _LOCAL_STEPS and s not in spaces]
    splits = pre.get("pretokenizers", [pre] if pre else [])
    dropped = any(
        s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")
        and s.get("pattern", {}).get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+")
        for s in splits
    )
    after = all(s.get("type") in ("Split", "ByteLevel") and not s.get("add_prefix_space") for s in splits)
    return not others and dropped and after and not spec.get("post_processor")


class TextEncoder:
    """Ids of texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        self.cached, self.ids, self.older, self.by_chunk = cached, {}, {}, False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.wide = pieces.get_piece_size() > 65_536
            self.kind = "<u4" if self.wide else "<u2"
            self.encode = lambda text: pieces.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 65_536
        self.kind = "<u4" if self.wide else "<u2"
        added = spec.get("added_tokens", [])
        self.by_chunk = _local_to_chunks(spec) and bool(added) and all(
            not t["lstrip"] and not t["rstrip"] and not t["normalized"] and "<|" in t["content"] for t in added
        )
        self.lowers = any(
            s.get("type") == "Lowercase" for s in (spec.get("normalizer") or {}).get("normalizers", [])
        )
        self.tokenize = self.library.model.tokenize
        self.mark = added[0]["content"] if added else ""
        self.mark_id = added[0]["id"] if added else -1
        self.encode = lambda text: self.library.encode(text, add_special_tokens=False).ids

    def _pack(self, ids) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.encode(text))

    def _learn(self, chunks: list[str]) -> None:
        """Ids of unseen chunks. Plain words go to the library's model, others to the whole library.

        A word of Latin letters is one piece for the pre-tokenizer, so normalising it and spelling its
        bytes is all that comes before the model. Other chunks are encoded in one call, parted by the
        mark of a special token.
        """
        ids, rest = self.ids, []
        letters = [c for c in chunks if c.isalpha() and max(c) < "\u0250"]
        spelt = self.library.normalizer.normalize_str(" ".join(letters)).split(" ") if letters else []
        if len(spelt) != len(letters):
            letters, spelt, rest = [], [], list(chunks)
        for chunk, word in zip(letters, spelt):
            if word.isalpha():
                data = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
                ids[chunk] = self._pack([t.id for t in self.tokenize(data)])
        rest = rest or [c for c in chunks if c not in ids]
        for lo in range(0, len(rest), 1024):
            part = rest[lo : lo + 1024]
            found = self.library.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids
            row, at = [], 0
            for i in found:
                if i == self.mark_id:
                    ids[part[at]] = self._pack(row)
                    row, at = [], at + 1
                else:
                    row.append(i)
            ids[part[at]] = self._pack(row)

    def packed(self, texts: pa.Array) -> pa.Array:
        """Little-endian unsigned ids (two bytes where the vocabulary allows it) of each text; null is empty."""
        made = [pa.array([], pa.binary())]
        for part in groups(texts, GROUP_BYTES):
            some = texts.slice(*part)
            if self.by_chunk:
                made.append(self._by_chunk(some))
            else:
                made.append(pa.array([self.whole(t or "") for t in some.to_pylist()], pa.binary()))
        return pa.concat_arrays(made)

    def _by_chunk(self, texts: pa.Array) -> pa.Array:
        plain = pc.fill_null(texts, "")
        odd = pc.match_substring(plain, "<|")
        some = pc.any(odd).as_py()
        if some:
            whole = [self.whole(t) for t in plain.filter(odd).to_pylist()]
            plain = pc.if_else(odd, "", plain)
        if self.lowers:
            plain = pc.ascii_lower(plain)
            plain = pc.replace_substring_regex(pc.replace_substring(plain, "\n", " "), "([a-z])([.,]) ", "\\1 \\2 ")
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.ids) > self.cached:
            self.ids, self.older = {}, self.ids
        ids, older = self.ids, self.older
        ids[""] = b""
        new = []
        for c in chunks:
            if c not in ids:
                if c in older:
                    ids[c] = older[c]
                else:
                    new.append(c)
        if new:
            self._learn(new)
        joined = pa.array([ids[c] for c in chunks], pa.binary()).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[split.offsets.to_numpy()]
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), joined.buffers()[2]])
        return pc.replace_with_mask(out, odd, pa.array(whole, pa.binary())) if some else out


#: The byte-level spelling: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards.
_BYTE_LETTERS = {}
for _b in range(256):
    if not (33 <= _b <= 126 or 161 <= _b <= 172 or _b >= 174):
        _BYTE_LETTERS[_b] = 256 + len(_BYTE_LETTERS)


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of a vocabulary file."""
    return held(("encoder", path), lambda: TextEncoder(path))


def packed_ids(text: Column, path: str) -> Column:
    """Binary column of little-endian unsigned ids."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return encoder(path).packed(texts)

    return packed(text)


# ---- the digest cache ----------------------------------------------------------------------

CACHE = "tokenizer string, digest binary, n_tokens bigint"
def _digested(text: Column, squeeze: bool, body: bool) -> Column:
    """UTF-8 bytes and the SHA-256 of the normalised content; with ``body``, that content compressed.

    Normalised by ``squeeze``: blanks at both ends are dropped and runs of ASCII white space are one
    blank, which a tokenizer that drops white space cannot tell apart. For other tokenizers, and for
    texts that hold a special token's mark, the content is taken as it is.
    """

    @F.arrow_udf("struct<n_bytes: bigint, digest: binary" + ", body: binary" * body + ">")
    def digested(texts: pa.Array) -> pa.Array:
        import zstandard

        packer, sizes, digests, bodies = zstandard.ZstdCompressor(level=1), [], [], []
        for t in texts.cast(pa.binary()):
            data = t.as_py() or b""
            same = b" ".join(data.split()) if squeeze and b"<|" not in data else data
            sizes.append(len(data))
            digests.append(hashlib.sha256(same).digest())
            if body:
                bodies.append(packer.compress(same))
        columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
        names = ["n_bytes", "digest"]
        if body:
            columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "body"]
        return pa.StructArray.from_arrays(columns, names)

    return digested(text)


def _counted(body: Column, path: str) -> Column:
    @F.arrow_udf("bigint")
    def counted(bodies: pa.Array) -> pa.Array:
        import zstandard

        own, opener, made = encoder(path), zstandard.ZstdDecompressor(), [pa.array([], pa.int64())]
        for part in groups(bodies, GROUP_BYTES // 4):
            texts = pa.array([opener.decompress(b).decode("utf-8") for b in bodies.slice(*part).to_pylist()], pa.string())
            sizes = pc.binary_length(own.packed(texts)).cast(pa.int64())
            made.append(pc.divide(sizes, 4 if own.wide else 2))
        return pa.concat_arrays(made)

    return counted(body)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; a folder that holds none yet is an empty cache."""
    from pyspark.errors import AnalysisException

    reader = spark.read.schema(CACHE)
    try:
        return reader.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, cache: str, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs`` (doc_id, text), by a digest cache.

    Contents are known by the SHA-256 of their normalised text and counts by that and the digest of the
    tokenizer file. Contents without a stored count are encoded once each, however many rows share them,
    and their counts are appended to the Parquet folder ``cache``; then every row takes its count from
    the store. Copies meet before the shuffle, so a text that a third of all rows share is one row in it.
    A repeated append of a count is harmless, as readers take one count per digest.

    Null is the empty text: no bytes, no tokens. Repeated rows come out as often as they came in. Extra
    columns are not looked at. An empty table gives an empty result and adds nothing to the cache.
    """
    spark, version = docs.sparkSession, file_digest(path)
    squeeze = TextEncoder(path).by_chunk
    rows = docs.select(_digested(F.col("text"), squeeze, body=True).alias("p")).select("p.*")
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = rows.select("digest", "body").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    fresh = misses.select(
        F.lit(version).alias("tokenizer"), "digest", _counted(F.col("body"), path).alias("n_tokens")
    )
    fresh.write.mode("append").parquet(cache)
    stored = (
        read_cache(spark, cache)
        .filter(F.col("tokenizer") == version)
        .groupBy("digest")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
    keyed = docs.select("doc_id", _digested(F.col("text"), squeeze, body=False).alias("d")).select("doc_id", "d.*")
    return keyed.join(cut_lineage(stored), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
