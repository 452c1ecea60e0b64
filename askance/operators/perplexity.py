"""Perplexity of texts under word-pair models counted from a corpus.

``fit`` counts and scores in one plan, with add-k smoothing; ``own_perplexities`` does the same for the corpus's own
texts in blocks. ``fit_costs`` makes a table of finished costs that is written once and read by any number of runs over
texts outside the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage

SMOOTHING = 0.1


@dataclass(frozen=True)
class PairModel:
    """Counts of word pairs with those of their first words, and the vocabulary size."""

    pairs: DataFrame  # w1, w2, c, c1
    firsts: DataFrame  # w1, c1
    vocabulary: Column

    def nll(self, c: Column, c1: Column) -> Column:
        k = F.lit(SMOOTHING)
        return -F.ln((F.coalesce(c, F.lit(0)) + k) / (F.coalesce(c1, F.lit(0)) + k * self.vocabulary))


def _pairs(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, w1, w2): each word with the one after it, NULL after a text's last word."""
    listed = texts.select(*keep, tx.words(F.col(text)).alias("_w"))
    zipped = F.arrays_zip(F.col("_w").alias("w1"), F.slice("_w", F.lit(2), F.size("_w")).alias("w2"))
    return listed.select(*keep, F.inline(zipped))


def fit(corpus: DataFrame, text: str = "text") -> PairModel:
    """One count of the corpus gives all three: every word is a first word once, so the number of
    different first words is the vocabulary's size; last words add nothing to ``c1``."""
    counts = _pairs(corpus, text).groupBy("w1", "w2").agg(F.count("*").alias("c"))
    followed = F.col("w2").isNotNull()
    firsts = counts.groupBy("w1").agg(F.coalesce(F.sum(F.when(followed, F.col("c"))), F.lit(0)).alias("c1"))
    return PairModel(counts.filter(followed).join(firsts, "w1"), firsts, firsts.agg(F.count("*").alias("v")).scalar())


def perplexities(texts: DataFrame, key: str, model: PairModel, text: str = "text", in_corpus: bool = False) -> DataFrame:
    """(key, chars, words, nll, token_ppl, char_ppl, word_ppl) for texts of two words or more.

    The first word is context only. A frequent pair is many rows on the text side and one on the
    model side, a join adaptive execution splits. With ``in_corpus`` the texts are part of what the
    model was counted on, so every pair is known and the second join falls away.
    """
    lengths = texts.select(
        key,
        F.length(tx.strip(F.col(text))).cast("bigint").alias("chars"),
        F.size(tx.words(F.col(text))).cast("bigint").alias("words"),
    ).filter(F.col("words") >= 2)
    own = _pairs(texts, text, key).filter(F.col("w2").isNotNull())
    if in_corpus:
        costed = own.join(model.pairs, ["w1", "w2"])
    else:
        known = own.join(model.pairs.select("w1", "w2", "c"), ["w1", "w2"], "left")
        costed = known.join(model.firsts, "w1", "left")
    nll = costed.groupBy(key).agg(F.sum(model.nll(F.col("c"), F.col("c1"))).alias("nll"))
    return _shown(lengths.join(nll, key), key)


def _shown(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        key, "chars", "words", "nll",
        F.exp(F.col("nll") / (F.col("words") - 1)).alias("token_ppl"),
        F.exp(F.col("nll") / F.col("chars")).alias("char_ppl"),
        F.exp(F.col("nll") / F.col("words")).alias("word_ppl"),
    )


# ---- the corpus's own texts, in blocks ----------------------------------------------------------

#: A block holds about so many words, or one longer text; a bucket of pairs about so many of the blocks' pairs.
BLOCK_WORDS, BUCKET_PAIRS = 1 << 20, 1 << 21


def own_perplexities(texts: DataFrame, key: str, text: str = "text", block_words: int = BLOCK_WORDS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """The columns of ``perplexities`` for the corpus's own texts, each row of ``texts`` by itself; no key, no row.

    A row per word of the corpus, sorted and joined, costs many times its bytes. Here a task cuts its texts once
    into blocks, in which a word is a small number and each word and pair stands once. A block's words
    get corpus-wide numbers and counts by one window over the words. Its pairs, two numbers each, go as arrays to
    buckets by pair, which grow in number with the corpus and send back an array of costs in the same order. A
    frequent word or pair is one entry per block, and no task holds more than some blocks or one bucket.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    shown = f"block bigint, key {kind}, chars bigint, words bigint"
    cut = cut_lineage(rows.mapInArrow(_cut(block_words), f"{shown}, ids array<int>, place int, word string, followed bigint"))
    same = Window.partitionBy("word")
    listed = cut.filter(F.col("word").isNotNull()).select("block", "place", "word", "followed", F.monotonically_increasing_id().alias("row"))
    numbered = cut_lineage(
        listed.select("block", "place", "row", "followed", F.min("row").over(same).alias("number"), F.sum("followed").over(same).alias("c1"))
    )
    size = numbered.agg(F.count_if(F.col("row") == F.col("number")).alias("v"), F.coalesce(F.sum("followed"), F.lit(0)).alias("n")).first()
    in_block = cut.filter(F.col("ids").isNotNull()).select("block", "key", "chars", "words", "ids").groupBy("block")
    paired = cut_lineage(
        in_block.cogroup(numbered.select("block", "place", "number", "c1").groupBy("block")).applyInArrow(
            _pair(-(-size["n"] // bucket_pairs)),
            f"{shown}, slots array<int>, bucket int, p1 array<bigint>, p2 array<bigint>, c1 array<bigint>, n array<bigint>",
        )
    )
    met = paired.filter(F.col("bucket").isNotNull()).select("block", "bucket", "p1", "p2", "c1", "n").groupBy("bucket")
    costs = met.applyInArrow(_cost(size["v"]), "block bigint, bucket int, costs array<double>")
    left = paired.filter(F.col("slots").isNotNull()).select("block", "key", "chars", "words", "slots").groupBy("block")
    nll = left.cogroup(costs.groupBy("block")).applyInArrow(_add_up, f"key {kind}, chars bigint, words bigint, nll double")
    return _shown(nll.filter(F.col("key").isNotNull()).withColumnRenamed("key", key), key)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy()


def _cut(block_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per block a row for each text of two words or more, its words as places in the block's list, and one for each word."""

    def rows(parts: list[tuple[pa.Array, ...]], block: int) -> Iterator[pa.RecordBatch]:
        keys, chars, words, flat = (pa.concat_arrays([part[i] for part in parts]) for i in range(4))
        coded, sizes = flat.dictionary_encode(), words.to_numpy()
        ids, n = coded.indices.to_numpy(), len(coded.dictionary)
        times = np.bincount(ids[_followed(sizes)], minlength=n)
        held = pa.array(sizes > 1)
        shown = {"key": keys, "chars": chars, "words": words, "ids": _lists(ids, sizes, pa.int32())}
        yield _batch(int((sizes > 1).sum()), block, keys.type, **{c: x.filter(held) for c, x in shown.items()})
        yield _batch(n, block, keys.type, place=pa.array(np.arange(n), pa.int32()), word=coded.dictionary, followed=pa.array(times, pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in _parts(batch, block_words):
                parts.append(part)
                size += len(part[3])
                if size >= block_words:
                    yield from rows(parts, block)
                    block, parts, size = block + 1, [], 0
        if size:
            yield from rows(parts, block)

    return cut


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, ...]]:
    """(keys, chars, words, all words) of about ``most`` bytes of text, or one longer text, at a time; no row without a word."""
    key, text = batch.column(0), batch.column(1).cast(pa.string())
    at = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64)) // most
    ends = [*np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
    for lo, hi in zip([0, *ends], ends):
        keys, texts = (c.slice(lo, hi - lo) for c in (key, text))
        listed = pc.utf8_split_whitespace(texts)  # Python's str.split(), but for empty words at the ends
        flat, row = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
        real = pc.not_equal(flat, "")
        words = np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=hi - lo)
        some = pa.array(words > 0)
        yield keys.filter(some), pc.utf8_length(pc.utf8_trim_whitespace(texts)).cast(pa.int64()).filter(some), pa.array(words, pa.int64()).filter(some), flat.filter(real)


def _followed(sizes: np.ndarray) -> np.ndarray:
    """Which of all words, text after text, are not a text's last."""
    out = np.ones(sizes.sum(), bool)
    out[np.cumsum(sizes) - 1] = False
    return out


def _batch(n: int, block: int, kind: pa.DataType, **given: pa.Array) -> pa.RecordBatch:
    ints = pa.int64()
    kinds = {"key": kind, "chars": ints, "words": ints, "ids": pa.list_(pa.int32()), "place": pa.int32(), "word": pa.string(), "followed": ints}
    columns = [given[c] if c in given else pa.nulls(n, k) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block), ints), *columns], ["block", *kinds])


def _pair(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per block its texts with a slot for each of their pairs, and its distinct pairs, slot after slot, by bucket."""
    shape = [("slots", pa.list_(pa.int32())), ("bucket", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("p1", "p2", "c1", "n")]]

    def pair(texts: pa.Table, words: pa.Table) -> pa.Table:
        schema = pa.schema([*[texts.schema.field(c) for c in ("block", "key", "chars", "words")], *shape])
        if not len(texts):
            return schema.empty_table()
        place = words["place"].to_numpy()
        number, c1 = np.empty((2, len(place)), np.int64)
        number[place], c1[place] = words["number"].to_numpy(), words["c1"].to_numpy()
        ids, sizes = _flat(texts["ids"]).astype(np.int64), texts["words"].to_numpy()
        at = np.flatnonzero(_followed(sizes))
        pairs, slots, n = np.unique(ids[at] * len(place) + ids[at + 1], return_inverse=True, return_counts=True)
        w1, w2 = np.divmod(pairs, len(place))
        p1, p2 = number[w1], number[w2]
        mixed = (p1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (p2.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        moved = np.empty(len(order), np.int32)
        moved[order] = np.arange(len(order))
        held, lengths = np.unique(bucket, return_counts=True)
        lists = [_lists(x[order], lengths, pa.int64()) for x in (p1, p2, c1[w1], n)]
        shown = [texts[c].combine_chunks() for c in ("block", "key", "chars", "words")]
        t = pa.Table.from_arrays([*shown, _lists(moved[slots], sizes - 1, pa.int32()), *[pa.nulls(len(texts), k) for _, k in shape[1:]]], schema=schema)
        own = pa.array(np.full(len(held), texts["block"][0].as_py()), pa.int64())
        none = [pa.nulls(len(held), schema.field(i).type) for i in range(1, 5)]
        return pa.concat_tables([t, pa.Table.from_arrays([own, *none, pa.array(held), *lists], schema=schema)])

    return pair


def _cost(vocabulary: int) -> Callable[[pa.Table], pa.Table]:
    """Per bucket the costs of its pairs, counted over all blocks."""

    def cost(met: pa.Table) -> pa.Table:
        p1, p2, c1, n = (_flat(met[c]) for c in ("p1", "p2", "c1", "n"))
        order = np.lexsort((p2, p1))
        a, b = p1[order], p2[order]
        starts = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        c = np.empty(len(order), np.int64)
        c[order] = np.add.reduceat(n[order], np.flatnonzero(starts))[np.cumsum(starts) - 1]
        costs = -np.log((c + SMOOTHING) / (c1 + SMOOTHING * vocabulary))
        lists = _lists(costs, pc.list_value_length(met["p1"]).to_numpy(), pa.float64())
        return pa.Table.from_arrays([met["block"].combine_chunks(), met["bucket"].combine_chunks(), lists], ["block", "bucket", "costs"])

    return cost


def _add_up(texts: pa.Table, costs: pa.Table) -> pa.Table:
    by_slot = _flat(costs.sort_by("bucket")["costs"])
    each, ends = by_slot[_flat(texts["slots"])], np.cumsum(texts["words"].to_numpy() - 1)
    nll = [float(part.sum()) for part in np.split(each, ends[:-1])]
    return texts.select(["key", "chars", "words"]).append_column("nll", pa.array(nll, pa.float64()))


# ---- a stored model: interpolated with the single words' shares -------------------------------

#: Kinds of cost rows: a pair seen; the step back from a first word; a word alone; a word never seen.
PAIR, BACK, WORD, UNSEEN = "pair", "back", "word", "unseen"
COSTS = "w1 string, w2 string, cost double, kind string"


def fit_costs(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(w1, w2, cost, kind): what each pair, each step back, each word alone and an unseen word cost.

    Interpolated as Witten and Bell do, with c1 the times that w1 is followed and t its different followers:
    p(w2 | w1) = (c + t p(w2)) / (c1 + t), p(w2) = (n + k) / (N + k (V + 1)). A pair not seen costs the step back
    from w1 (-ln(t / (c1 + t)), nothing if w1 was never followed) plus w2 alone. The corpus is counted
    once; all else is joins of counts, which no frequent word makes longer than the vocabulary. An empty corpus gives
    the unseen word alone, at no cost. NULL and empty texts have no words.
    """
    counts = cut_lineage(_pairs(corpus, text).groupBy("w1", "w2").agg(F.count("*").alias("c")))
    followed = counts.filter(F.col("w2").isNotNull())
    firsts = followed.groupBy("w1").agg(F.sum("c").alias("c1"), F.count("*").alias("t"))
    k = F.lit(SMOOTHING)
    words = counts.groupBy(F.col("w1").alias("w2")).agg(F.sum("c").alias("n"))
    total = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.count("*").alias("all_v")
    ).select((F.col("all_n") + k * (F.col("all_v") + 1)).alias("whole"))
    shares = words.select("w2", ((F.col("n") + k) / total.scalar()).alias("p"))
    pairs = followed.join(firsts, "w1").join(shares, "w2")
    none = F.lit(None).cast("string")
    return (
        pairs.select("w1", "w2", (-F.ln((F.col("c") + F.col("t") * F.col("p")) / (F.col("c1") + F.col("t")))).alias("cost"), F.lit(PAIR).alias("kind"))
        .unionByName(firsts.select("w1", none.alias("w2"), (-F.ln(F.col("t") / (F.col("c1") + F.col("t")))).alias("cost"), F.lit(BACK).alias("kind")))
        .unionByName(shares.select(none.alias("w1"), "w2", (-F.ln("p")).alias("cost"), F.lit(WORD).alias("kind")))
        .unionByName(total.select(none.alias("w1"), none.alias("w2"), (-F.ln(k / F.col("whole"))).alias("cost"), F.lit(UNSEEN).alias("kind")))
    )


def write_costs(costs: DataFrame, path: str) -> None:
    """A folder per kind, so that a reader of one kind leaves the others unread."""
    costs.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COSTS).parquet(path)


def stored_perplexities(texts: DataFrame, key: str, costs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``perplexities`` for texts of two words or more, by a table of ``fit_costs``.

    Equal pairs of a text are one row with a count before they meet the model. Pairs it knows are done with one
    join; the rest goes on to the step back and the single word. Left joins, so adaptive execution may
    split a first word that begins many pairs. ``key`` is unique.
    """
    lengths = texts.select(
        key,
        F.length(tx.strip(F.col(text))).cast("bigint").alias("chars"),
        F.size(tx.words(F.col(text))).cast("bigint").alias("words"),
    ).filter(F.col("words") >= 2)
    own = _pairs(texts, text, key).filter(F.col("w2").isNotNull()).groupBy(key, "w1", "w2").agg(F.count("*").alias("n"))

    def of(kind: str, *columns: str, name: str) -> DataFrame:
        return costs.filter(F.col("kind") == kind).select(*columns, F.col("cost").alias(name))

    met = cut_lineage(own.join(of(PAIR, "w1", "w2", name="seen"), ["w1", "w2"], "left"))
    unseen = of(UNSEEN, name="unseen").select(F.first("unseen")).scalar()
    rest = met.filter(F.col("seen").isNull()).join(of(BACK, "w1", name="back"), "w1", "left").join(of(WORD, "w2", name="alone"), "w2", "left")
    cost = F.coalesce("back", F.lit(0.0)) + F.coalesce("alone", unseen)
    costed = met.filter(F.col("seen").isNotNull()).select(key, (F.col("n") * F.col("seen")).alias("_x"))
    nll = costed.unionByName(rest.select(key, (F.col("n") * cost).alias("_x"))).groupBy(key).agg(F.sum("_x").alias("nll"))
    return _shown(lengths.join(nll, key), key)


def means(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_texts"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("chars", "words", "nll", "token_ppl", "char_ppl", "word_ppl")],
    )
