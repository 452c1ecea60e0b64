"""Toxicity by multiple-instance learning: sentences carry the score, documents carry the labels.

A document is a bag of sentences. A sentence is toxic with probability p = 1 / (1 + exp(-z)), z being a bias plus
the weights of its distinct word features; a document is toxic unless all of its sentences are clean:

    P = 1 - (1 - p1)(1 - p2)...(1 - pn)

Only P meets a label. Its gradient reaches the sentences in proportion to what each adds to P, so the weights settle
on the sentences that explain the label, and the same weights then point at the offending sentences. Features are
hashes of a word and of its first three, four and five characters: whatever is inflected or compounded meets its stem.

The fit is bounded: ``SAMPLE_ROWS`` labelled rows of each label, drawn by hash, none over ``LONGEST_TEACHER``
characters; rows weigh so that the shares of the labels are those of all labelled rows. Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, held

#: The bound of the fit: rows of each label, and characters of a row (longer ones teach nothing).
SAMPLE_ROWS = 4_000
LONGEST_TEACHER = 100_000
BUCKETS = 1 << 20
#: A feature is used when its share of toxic documents differs by so many standard errors, in so many rows.
LEAST_Z = 5.0
LEAST_ROWS = 8
MOST_FEATURES = 4_096
RIDGE = 2e-3
STEPS = 160
THRESHOLD = 0.5
_WORDS_HELD = 200_000

_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\s][^.!?\n]*(?:[.!?]+|\n|\Z)")
_WORD = re.compile(r"[^\W\d_]+")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence: up to a run of full stops, question or exclamation marks, or a line's end.
    Stretches of white space and marks alone are no sentence."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def features(word: str) -> list[int]:
    """Hash buckets of a lower-case word and its stems; a stem as long as the word is another feature."""
    return [crc32(f"{n}{word[:n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in (3, 4, 5) if len(word) >= n] + [
        crc32(f"w{word}".encode("utf-8", "surrogatepass")) % BUCKETS
    ]


@dataclass(frozen=True)
class Model:
    """Bias and weight per kept feature bucket."""

    bias: float
    weights: dict[int, float]


class Scorer:
    """Scores texts; the summed weight of a word is kept for its next occurrence, up to a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def word(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            weights = self.model.weights
            got = sum(weights.get(f, 0.0) for f in dict.fromkeys(features(word)))
            if len(self.known) >= _WORDS_HELD:
                self.known.clear()
            self.known[word] = got
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, p) of each sentence of the text."""
        found = []
        for start, end in sentence_spans(text):
            words = set(_WORD.findall(text[start:end].lower()))
            z = self.model.bias + sum(map(self.word, sorted(words)))
            found.append((start, end, 1.0 / (1.0 + np.exp(-min(max(z, -60.0), 60.0)))))
        return found


def noisy_or(shares) -> float:
    """1 - product of (1 - p); 0 for no sentence."""
    shares = np.asarray(shares, dtype=np.float64)
    return float(-np.expm1(np.log1p(-np.minimum(shares, 1 - 1e-15)).sum())) if len(shares) else 0.0


def fold(doc_id: str = "doc_id") -> Column:
    """The documents' fold: crc32 of the id as text, modulo 5. Fold 0 is held out from learning."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def _bags(sample: DataFrame) -> DataFrame:
    """(toxic, sentences): the distinct feature buckets of each sentence."""

    def bag(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column(1).to_pylist():
                words = (set(_WORD.findall(text[a:b].lower())) for a, b in sentence_spans(text))
                rows.append([sorted({f for w in ws for f in features(w)}) for ws in words])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(rows, pa.list_(pa.list_(pa.int32())))], ["toxic", "sentences"]
            )

    return sample.select("toxic", "text").mapInArrow(bag, "toxic int, sentences array<array<int>>")


def telling(bags: DataFrame) -> np.ndarray:
    """The buckets whose share of documents differs most between the labels, ascending.

    Tasks count their own documents; a row per task and bucket moves, and at most ``MOST_FEATURES`` reach the driver.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by = np.zeros((2, BUCKETS), dtype=np.int32)
        for part in parts:
            for toxic, listed in zip(part.column(0).to_pylist(), part.column(1)):
                held_by[toxic, np.unique(listed.values.flatten().to_numpy())] += 1
        some = np.flatnonzero(held_by.any(axis=0))
        for at in range(0, len(some), 100_000):
            b = some[at : at + 100_000]
            columns = [pa.array(b, pa.int32()), pa.array(held_by[0, b], pa.int64()), pa.array(held_by[1, b], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "clean", "toxic"])

    sizes = {r["toxic"]: float(r["count"]) for r in bags.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return np.zeros(0, dtype=np.int64)
    counts = bags.mapInArrow(count, "bucket int, clean bigint, toxic bigint").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    share = (F.col("clean") + F.col("toxic")) / (sizes[0] + sizes[1])
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / sizes[0] + 1 / sizes[1]))
    z = F.abs(F.col("toxic") / sizes[1] - F.col("clean") / sizes[0]) / spread
    found = counts.filter(F.col("clean") + F.col("toxic") >= LEAST_ROWS).select("bucket", z.alias("z")).filter(F.col("z") >= LEAST_Z)
    return np.sort([r["bucket"] for r in found.orderBy(F.desc("z"), "bucket").limit(MOST_FEATURES).collect()]).astype(np.int64)


def _packed(bags: DataFrame, kept: np.ndarray) -> DataFrame:
    """(toxic, n_sentences, places): each sentence's places among the ``kept`` buckets, sentences without one left out."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[kept] = np.arange(len(kept))
        for part in parts:
            counts, rows = [], []
            for listed in part.column(1):
                sentences = [place[s] for s in listed.as_py()]
                counts.append(len(sentences))
                rows.append([s[s >= 0] for s in sentences if (s >= 0).any()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(pa.list_(pa.int32())))],
                ["toxic", "n_sentences", "places"],
            )

    return bags.mapInArrow(pack, "toxic int, n_sentences bigint, places array<array<int>>")


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of at most ``rows`` rows per label, those of least hash, and the number of labelled rows of each.

    Labels other than 0 and 1, and rows without text or with too long a one, teach nothing.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.coalesce(fold() != 0, F.lit(False))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    # The draw is by label row, so only the drawn ids meet the texts.
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id")
    drawn = known.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows).drop("n")
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, LONGEST_TEACHER))
    return texts.join(F.broadcast(drawn), "doc_id").select("toxic", "text"), counts


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of ``labels`` (doc_id, toxic) over ``docs`` (doc_id, text); only rows outside fold 0 teach.

    Without rows of both labels nothing can be learned: the bias alone remains, all scores are near 0.
    """
    sample, counts = sampled(docs, labels, rows)
    bags = cut_lineage(_bags(sample))
    kept = telling(bags)
    if not len(kept):
        return Model(-12.0, {})
    return _fitted(_packed(bags, kept).toArrow(), kept, counts)


def _fitted(packed: pa.Table, kept: np.ndarray, counts: dict[int, int]) -> Model:
    """Weights by gradient descent on the likelihood of the bags (toxic, n_sentences, places)."""
    toxic, n_sentences = packed.column("toxic").to_numpy(), packed.column("n_sentences").to_numpy()
    listed = pa.concat_arrays(packed.column("places").chunks)
    inner = listed.flatten()
    cols, held_of = inner.flatten().to_numpy(), np.diff(inner.offsets.to_numpy())
    told_of = np.diff(listed.offsets.to_numpy())  # sentences with a feature, per bag
    bag_of = np.repeat(np.arange(len(toxic)), told_of)
    starts = np.cumsum(held_of) - held_of
    plain = (n_sentences - told_of).astype(np.float64)  # the others have the bias alone

    y = toxic.astype(np.float64)
    share = np.array([counts[0] / (toxic == 0).sum(), counts[1] / (toxic == 1).sum()])[toxic]
    weight = share / share.sum()
    w = np.zeros(len(kept) + 1)
    w[-1] = np.log(max(1e-9, (weight * y).sum()) / max(1.0, n_sentences.mean()))
    first, second, rate = np.zeros_like(w), np.zeros_like(w), 0.1
    for step in range(1, STEPS + 1):
        z = np.add.reduceat(w[cols], starts) + w[-1]
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
        base = 1.0 / (1.0 + np.exp(-w[-1]))
        clean = np.bincount(bag_of, weights=np.logaddexp(0.0, z), minlength=len(y)) + plain * np.logaddexp(0.0, w[-1])
        # d loss / d clean: 1 for label 0; -1 / (e^clean - 1) for label 1
        pull = weight * np.where(y == 1, -1.0 / np.expm1(np.maximum(clean, 1e-9)), 1.0)
        by_sentence = pull[bag_of] * p
        slope = np.append(
            np.bincount(cols, weights=np.repeat(by_sentence, held_of), minlength=len(kept)), by_sentence.sum() + (pull * plain).sum() * base
        )
        slope[:-1] += RIDGE / len(kept) * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(float(w[-1]), {int(b): float(v) for b, v in zip(kept, w[:-1])})


_SCORED = "struct<score:double,n_sentences:bigint,offending:array<struct<start:int,end:int,score:double>>>"


def scored(text: Column, model: Model) -> Column:
    """Struct (score, n_sentences, offending) of a text; offending sentences are those with p of ``THRESHOLD`` or more,
    in order, as code point offsets, end exclusive. A null or empty text has no sentence and scores 0."""
    key = ("toxicity", uuid4().hex)

    @F.arrow_udf(_SCORED)
    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = held(key, lambda: Scorer(model))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for texts in parts:
            found = [scorer.sentences(t or "") for t in texts.to_pylist()]
            offending = [[{"start": a, "end": b, "score": p} for a, b, p in rows if p >= THRESHOLD] for rows in found]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([noisy_or([p for *_, p in rows]) for rows in found], pa.float64()),
                    pa.array([len(rows) for rows in found], pa.int64()),
                    pa.array(offending, pa.list_(span)),
                ],
                ["score", "n_sentences", "offending"],
            )

    return judged(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending) per row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, toxic) outside fold 0. A null doc_id is in no fold: not held out, not learned from.
    Repeated rows come out as often as they came in; columns beside doc_id and text are not looked at.
    """
    model = learn(docs, labels)
    return docs.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), scored(F.col("text"), model).alias("s")
    ).select("doc_id", "held_out", "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.n_sentences", "s.offending")
