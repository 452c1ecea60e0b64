"""Language ID by compression: the language whose dictionary packs a text into the fewest bytes.

Each language has a raw-content zstandard dictionary: the words of a bounded sample of its labelled rows,
the commonest last, where they are cheapest to point at. Every text is encoded whole and in one way: folded
to lower case with digits and ASCII marks as blanks, in pieces of ``PIECE_BYTES``, each with every language's
dictionary; a language's size is the sum over the pieces, so the dictionary serves the end of a long text as
well as its start and margins compare across lengths. The smallest size names the language. The margin is
the share by which the runner-up is larger; narrow margins are rejected.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held

#: The bound of the fit: rows per language, characters of each, and bytes of a dictionary.
ROWS_PER_LANGUAGE = 900
CHARS_PER_ROW = 1_500
DICTIONARY_BYTES = 128 * 1024
#: Rejected below this margin (share of the best size by which the second best is larger).
MIN_MARGIN = 0.004
UNDECIDED = "und"
LEVEL = 6
PIECE_BYTES = 4_000
#: Each piece follows so many bytes of the dictionary's own end. They cost a few bytes in any language and
#: keep the encoder from storing a short piece raw, which would make all sizes equal.
LEAD_BYTES = 2_000
#: Bytes of difference that make a verdict e times as likely.
_BYTES_PER_E = 2.0


def learn(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary per value of ``lang``, from ``labelled`` (doc_id, text, lang).

    The sample is bounded: the ``rows`` texts of least hash per language (where hashes fall very unevenly, a
    few less), ``CHARS_PER_ROW`` characters of
    each, ``size`` bytes in all. Rows with a null label or a text without a letter teach nothing.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return {}
    # Of each language only as many as are needed, and half as many more, leave the scan.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40))
    pairs = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 40, (rows * 3 << 39) // n + 1))]
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    sample = (
        usable.select("lang", "doc_id", F.substring("text", 1, CHARS_PER_ROW).alias("text"), draw.alias("draw"))
        .filter(F.col("draw") < F.element_at(F.create_map(*pairs), F.col("lang")))
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= rows)
        .orderBy("lang", "n")
        .collect()
    )
    seen: dict[str, Counter] = {}
    for r in sample:
        seen.setdefault(r["lang"], Counter()).update(set(_words(r["text"])))
    made = {}
    for lang, counts in seen.items():
        ranked = sorted(counts, key=lambda w: (-counts[w], w))
        ends = list(accumulate(len(w) + 1 for w in ranked))
        made[lang] = b" ".join(reversed(ranked[: bisect_right(ends, size)]))
    return made


def _words(text: str) -> list[bytes]:
    """Lower-case words without digits and ASCII marks: what tells languages apart."""
    return text.lower().encode("utf-8").translate(_KEPT).split()


def _pieces(text: str) -> list[bytes]:
    """The whole folded text, in order, cut into pieces."""
    data = b" ".join(_words(text))
    return [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]


_KEPT = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


class Compressors:
    """A compressor per language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = sorted(dictionaries)
        self.packers = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
            self.packers.append((packer, dictionaries[name][-LEAD_BYTES:] + b" "))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language or und, score from 0 to 1, margin)."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNDECIDED, 0.0, 0.0
        pieces = _pieces(text)
        sizes = [sum(len(p.compress(lead + piece)) for piece in pieces) for p, lead in self.packers]
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        best, second = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))[:2]
        score = 1 / sum(math.exp(max(-700.0, (sizes[best] - s) / _BYTES_PER_E)) for s in sizes)
        return self.names[best], score, sizes[second] / sizes[best] - 1


def predicted(text: Column, dictionaries, min_margin: float = MIN_MARGIN) -> Column:
    """Struct (lang_pred, score, margin, rejected) of a text; ``dictionaries`` is a broadcast of ``learn``.

    Null texts and texts without a letter are ``und`` with score 0 and are rejected. Equal sizes go to the
    first language by name, with margin 0, and are rejected.
    """

    key = ("langid", uuid4().hex)

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = held(key, lambda: Compressors(dictionaries.value))
        for texts in parts:
            rows = [compressors.judge(t) for t in texts]
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "margin"])
            out["rejected"] = (out["lang_pred"] == UNDECIDED) | (out["margin"] < min_margin)
            yield out

    return judged(text)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """The documents' fold: crc32 of the id as text, modulo 3. Fold 1 is held out from learning."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3


def identify(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) per row of ``docs`` (doc_id, text, lang).

    Learns only from rows outside fold 1 with a label. A null doc_id is in no fold: it is not held out and
    not learned from. Without any labelled row every text is ``und``. Repeated rows come out as often as
    they came in. Columns beside doc_id, text and lang are not looked at.
    """
    model = trained(docs)
    return docs.select(
        "doc_id",
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        predicted(F.col("text"), model, min_margin).alias("p"),
    ).select("doc_id", "held_out", "p.*")


def trained(docs: DataFrame):
    """Broadcast dictionaries from the rows outside the held-out fold; languages x ``DICTIONARY_BYTES``."""
    labelled = docs.filter(fold() != 1).select("doc_id", "text", "lang")
    return docs.sparkSession.sparkContext.broadcast(learn(labelled))


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` without the rows whose language is rejected; the rows that stay are unchanged."""
    return docs.filter(~predicted(F.col("text"), trained(docs), min_margin)["rejected"])
