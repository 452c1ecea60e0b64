"""Text-against-reference measures: BLEU, ROUGE, exact match and F1, accuracy.

A prediction and its reference sit in one row, so their common n-grams are counted in the row, in
Arrow batches: nothing moves but the few sums per row. Counting them by grouping on the n-gram
would shuffle every n-gram of every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


#: So many rows of an Arrow batch are Python lists at a time: a batch holds up to 10,000 rows, and each token as a
#: Python string takes ten times its bytes.
_AT_ONCE = 64


def _rows(*columns: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of a batch as arrays of tokens; NULL is an empty one."""
    for lo in range(0, len(columns[0]), _AT_ONCE):
        parts = [c.slice(lo, _AT_ONCE).to_pandas() for c in columns]
        yield from zip(*[[() if x is None else x for x in part] for part in parts])


def clipped_hits(pred: list[str], gold: list[str], n: int) -> int:
    """Common n-grams, each as often as the side that has it less."""
    mine, theirs = (Counter(zip(*(tokens[i:] for i in range(n)))) for tokens in (pred, gold))
    if len(mine) > len(theirs):
        mine, theirs = theirs, mine
    return sum(min(times, theirs[gram]) for gram, times in mine.items() if gram in theirs)


def batch_hits(preds: pa.Array, golds: pa.Array, order: int) -> np.ndarray:
    """``clipped_hits`` for n = 1..order of each row; n-grams are numbers, one sort of all rows' per n. NULL is an empty row."""
    both, rows = pa.concat_arrays([preds, golds]), len(preds)
    sizes = pc.fill_null(pc.list_value_length(both), 0).to_numpy().astype(np.int64)
    coded = both.flatten().dictionary_encode()
    owner, left = np.repeat(np.arange(2 * rows), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    in_gold, row, at = owner >= rows, owner % max(rows, 1), np.arange(len(owner))
    single = grams = row * len(coded.dictionary) + coded.indices.to_numpy()
    out = np.zeros((rows, order), np.int64)
    for n in range(1, order + 1):
        if n > 1:
            kept = left[at] >= n
            at = at[kept]
            grams = grams[kept] * base + single[at + n - 1]
        if not len(at):
            break
        named, grams = np.unique(grams, return_inverse=True)
        if n == 1:
            single, base = grams, len(named)
        mine, theirs = (np.bincount(grams[side], minlength=len(named)) for side in (~in_gold[at], in_gold[at]))
        home = np.empty(len(named), np.int64)
        home[grams] = row[at]
        np.add.at(out[:, n - 1], home, np.minimum(mine, theirs))
    return out


def _hits(pred: Column, gold: Column, order: int) -> Column:
    """ARRAY<BIGINT>: the common n-grams for n = 1..order."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for preds, golds in batches:
            parts = [batch_hits(preds.slice(lo, _AT_ONCE), golds.slice(lo, _AT_ONCE), order) for lo in range(0, len(preds), _AT_ONCE)]
            yield pa.array(np.concatenate([np.zeros((0, order), np.int64), *parts]).tolist(), pa.list_(pa.int64()))

    return count(pred, gold)


def _grams(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def bleu(rows: DataFrame, run: list[str] | None = None, pred: str = "prediction", gold: str = "reference", order: int = 4) -> DataFrame:
    """Corpus BLEU per run: score, the four precisions, brevity penalty, length ratio, lengths."""
    run = run or []
    orders = range(1, order + 1)
    tokens = rows.select(*run, tx.bleu_tokens(F.col(pred)).alias("_p"), tx.bleu_tokens(F.col(gold)).alias("_g"))
    counted = tokens.select(
        *run, _hits(F.col("_p"), F.col("_g"), order).alias("_m"), F.size("_g").alias("_ng"),
        *[_grams(F.col("_p"), n).alias(f"_t{n}") for n in orders],
    )
    total = counted.groupBy(*run).agg(
        *[F.sum(F.get("_m", n - 1)).cast("double").alias(f"m{n}") for n in orders],
        *[F.sum(f"_t{n}").alias(f"t{n}") for n in orders],
        F.sum("_ng").alias("reference_length"),
    )
    shares = {f"precision_{n}": F.coalesce(F.try_divide(F.col(f"m{n}"), F.col(f"t{n}").cast("double")), F.lit(0.0)) for n in orders}
    total = total.withColumns(shares).withColumn("translation_length", F.col("t1")).withColumn(
        "length_ratio", F.try_divide(F.col("t1").cast("double"), F.col("reference_length").cast("double"))
    )
    ratio = F.col("length_ratio")
    penalty = F.when(ratio > 1, F.lit(1.0)).when(ratio > 0, F.exp(1 - 1 / ratio)).otherwise(F.lit(0.0))
    logs = sum((F.ln(f"precision_{n}") for n in orders[1:]), F.ln("precision_1"))
    geometric = F.when(F.least(*shares) > 0, F.exp(logs / order)).otherwise(F.lit(0.0))
    total = total.withColumn("brevity_penalty", penalty)
    return total.withColumn("bleu", geometric * F.col("brevity_penalty")).select(
        *run, "bleu", *shares, "brevity_penalty", "length_ratio", "translation_length", "reference_length"
    )


def f_measure(hits: Column, in_pred: Column, in_gold: Column) -> Column:
    """F1 from counts: 2 hits / (pred + gold); 0 when there is no hit."""
    return F.coalesce(F.try_divide((2 * hits).cast("double"), (in_pred + in_gold).cast("double")), F.lit(0.0))


def rouge_n(rows: DataFrame, keys: list[str], pred: str = "prediction", gold: str = "reference") -> DataFrame:
    """(keys, rouge1, rouge2) per row."""
    tokens = rows.select(*keys, tx.rouge_tokens(F.col(pred)).alias("_p"), tx.rouge_tokens(F.col(gold)).alias("_g"))
    counted = tokens.withColumn("_m", _hits(F.col("_p"), F.col("_g"), 2))
    return counted.select(
        *keys,
        *[f_measure(F.get("_m", n - 1), _grams(F.col("_p"), n), _grams(F.col("_g"), n)).alias(f"rouge{n}") for n in (1, 2)],
    )


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit rows: one big-integer step per token of ``b``."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def bit_places(tokens: list[str]) -> dict[str, int]:
    """The places of each token, as set bits."""
    places: dict[str, int] = {}
    for i, token in enumerate(tokens):
        places[token] = places.get(token, 0) | (1 << i)
    return places


def lcs_members(gold: list[str], pred: list[str], places: dict[str, int] | None = None) -> set[int]:
    """Positions in ``gold`` of one longest common subsequence with ``pred``, whose ``bit_places`` may be given.

    Forward bit rows are kept per gold token and walked back from the end, preferring to step
    back in ``pred``'s prefix only where that loses nothing. Gold tokens that ``pred`` lacks leave the
    row as it is and the walk steps over them, so they are left out first: most of a long text's.
    """
    if gold == pred:
        return set(range(len(gold)))
    places = bit_places(pred) if places is None else places
    full = (1 << len(pred)) - 1
    shared = [i for i, token in enumerate(gold) if token in places]
    row, rows = full, [full]
    for i in shared:
        hit = row & places[gold[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found: set[int] = set()
    i, j = len(shared), len(pred)
    length = j - row.bit_count()  # of the first i shared tokens with the first j of pred; a clear bit is a step up
    while length:
        if gold[shared[i - 1]] == pred[j - 1]:
            found.add(shared[i - 1])
            i, j, length = i - 1, j - 1, length - 1
        elif rows[i] >> (j - 1) & 1 and j - (rows[i - 1] & ((1 << j) - 1)).bit_count() < length:
            j -= 1
        else:
            i -= 1
    return found


@F.arrow_udf(T.LongType())
def _lcs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([lcs_length(list(x), list(y)) for x, y in _rows(a, b)], pa.int64())


@F.arrow_udf(T.LongType())
def _union_lcs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Summary-level hits: for each gold line the union of its common subsequences with every
    predicted line, each token used at most as often as either text holds it."""
    for golds, preds in batches:
        out = []
        for gold_lines, pred_lines in _rows(golds, preds):
            lines_g, lines_p = [list(x) for x in gold_lines], [list(x) for x in pred_lines]
            left_g: dict[str, int] = {}
            left_p: dict[str, int] = {}
            for line in lines_g:
                for t in line:
                    left_g[t] = left_g.get(t, 0) + 1
            for line in lines_p:
                for t in line:
                    left_p[t] = left_p.get(t, 0) + 1
            hits, places = 0, [bit_places(p) for p in lines_p]
            for g in lines_g:
                union: set[int] = set()
                held = set(g)
                for p, at in zip(lines_p, places):
                    if not held.isdisjoint(at):
                        union |= lcs_members(g, p, at)
                for i in sorted(union):
                    t = g[i]
                    if left_g.get(t, 0) > 0 and left_p.get(t, 0) > 0:
                        hits += 1
                        left_g[t] -= 1
                        left_p[t] -= 1
            out.append(hits)
        yield pa.array(out, pa.int64())


def _lines(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\n"), lambda s: F.length(s) > 0), tx.rouge_tokens)


def rouge_l(rows: DataFrame, keys: list[str], pred: str = "prediction", gold: str = "reference") -> DataFrame:
    """(keys, rougeL, rougeLsum): whole text as one line, and line by line."""
    return rouge(rows, keys, pred, gold).drop("rouge1", "rouge2")


def rouge(rows: DataFrame, keys: list[str], pred: str = "prediction", gold: str = "reference") -> DataFrame:
    """(keys, rouge1, rouge2, rougeL, rougeLsum) by one tokenisation of each row."""
    prepared = rows.select(
        *keys,
        tx.rouge_tokens(F.col(pred)).alias("_p"), tx.rouge_tokens(F.col(gold)).alias("_g"),
        _lines(F.col(pred)).alias("_pl"), _lines(F.col(gold)).alias("_gl"),
    )
    total = lambda lines: F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.size(x))
    return prepared.select(
        *keys,
        _hits(F.col("_p"), F.col("_g"), 2).alias("_m"),
        *[_grams(F.col(c), 2).alias(f"{c}2") for c in ("_p", "_g")],
        _lcs(F.col("_p"), F.col("_g")).alias("_l"), _union_lcs(F.col("_gl"), F.col("_pl")).alias("_u"),
        F.size("_p").alias("_np"), F.size("_g").alias("_ng"),
        total(F.col("_pl")).alias("_npl"), total(F.col("_gl")).alias("_ngl"),
    ).select(
        *keys,
        f_measure(F.get("_m", 0), F.col("_np"), F.col("_ng")).alias("rouge1"),
        f_measure(F.get("_m", 1), F.col("_p2"), F.col("_g2")).alias("rouge2"),
        f_measure(F.col("_l"), F.col("_np"), F.col("_ng")).alias("rougeL"),
        f_measure(F.col("_u"), F.col("_npl"), F.col("_ngl")).alias("rougeLsum"),
    )


def squad(rows: DataFrame, key: str, pred: str = "prediction", golds: str = "answers") -> DataFrame:
    """(key, exact_match, f1) on a 0..1 scale: the best over the row's gold answers."""
    tokens = rows.select(
        key, tx.answer_tokens(F.col(pred)).alias("_p"), F.transform(golds, tx.answer_tokens).alias("_gs")
    )
    exact = F.exists("_gs", lambda g: g == F.col("_p")).cast("double").alias("exact_match")
    return tokens.select(key, exact, _best_f1(F.col("_p"), F.col("_gs")).alias("f1"))


@F.arrow_udf(T.DoubleType())
def _best_f1(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for preds, golds in batches:
        out = []
        for pred, answers in _rows(preds, golds):
            p = list(pred)
            best = 0.0
            for answer in answers:
                g = list(answer)
                hits = clipped_hits(p, g, 1)
                best = max(best, 2 * hits / (len(p) + len(g)) if hits else 0.0)
            out.append(best)
        yield pa.array(out, pa.float64())


def accuracy(predicted: Column, label: Column) -> Column:
    return F.avg((predicted == label).cast("double"))


def positive_label(text: Column) -> Column:
    """1 when the text holds POSITIVE in capitals, else 0."""
    return F.when(F.contains(text, F.lit("POSITIVE")), 1).otherwise(0)
