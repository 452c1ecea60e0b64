"""Sentence agreement with sampled answers, and the split it leads to.

The default score of a sentence against one sample is the share of the sentence's distinct
character trigrams the sample lacks. The mean over the samples needs only how many samples
hold each trigram, so no sentence-sample pair is ever made:

* samples kept as a pool (long table): count holders per (pool, trigram), join on that key;
* samples in the question's own row (as a generator returns them): a row expression.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


def nan() -> Column:
    return F.lit("NaN").cast("double")


def sentence_rows(passages: DataFrame, *keep: str) -> DataFrame:
    """(q_id, sent_idx, sentence): one row per passage sentence."""
    return passages.select("q_id", *keep, F.posexplode(tx.sentences(F.col("passage"))).alias("sent_idx", "sentence"))


def trigram_holders(samples: DataFrame, pool: str = "pool_id", text: str = "text") -> DataFrame:
    """(pool, tri, holders): how many samples of the pool hold the trigram.

    The row with the empty trigram counts the pool's samples, so one join brings both.
    """
    tri = F.array_append(tx.trigrams(F.col(text)), "")
    return samples.select(F.col(pool).alias("pool_id"), F.explode(tri).alias("tri")).groupBy("pool_id", "tri").agg(
        F.count("*").alias("holders")
    )


def sentence_support(passages: DataFrame, samples: DataFrame, passage_in_pool: bool = False) -> DataFrame:
    """Per sentence: its trigrams, the samples it is held against, and the hits over all of them.

    ``passages``: q_id, pool_id, passage. ``samples``: pool_id, text. With ``passage_in_pool`` the
    passage itself is one of the pool's texts and is left out: it holds every trigram of its own
    sentences, so it takes one off each count.
    """
    own = 1 if passage_in_pool else 0
    # "" finds the pool size; it is also what a sentence too short for trigrams still has
    tri = F.array_append(tx.trigrams(F.col("sentence")), "")
    rows = sentence_rows(passages, "pool_id").select("q_id", "pool_id", "sent_idx", F.explode(tri).alias("tri"))
    size = F.max(F.when(F.col("tri") == "", F.col("holders")))
    return (
        rows.join(trigram_holders(samples), ["pool_id", "tri"], "left")
        .groupBy("q_id", "sent_idx")
        .agg(
            F.count_if(F.col("tri") != "").alias("n_trigrams"),
            (F.coalesce(size, F.lit(0)) - own).cast("bigint").alias("n_samples"),
            F.coalesce(F.sum(F.when(F.col("tri") != "", F.col("holders") - own)), F.lit(0)).alias("hits"),
        )
        .select("q_id", "sent_idx", "n_trigrams", F.greatest("n_samples", F.lit(0)).alias("n_samples"), "hits")
    )


def sentence_scores(passages: DataFrame, samples: DataFrame, passage_in_pool: bool = False) -> DataFrame:
    """(q_id, sent_idx, score): mean share of trigrams absent; NaN without trigrams or samples."""
    pairs = F.col("n_trigrams") * F.col("n_samples")
    share = 1 - F.try_divide(F.col("hits").cast("double"), pairs.cast("double"))
    return sentence_support(passages, samples, passage_in_pool).select(
        "q_id", "sent_idx", F.coalesce(share, nan()).alias("score")
    )


def nan_mean(score: Column) -> Column:
    """Mean of the numbers; NaN when there is none."""
    return F.coalesce(F.avg(F.when(~F.isnan(score), score)), nan())


def passage_scores(passages: DataFrame, scores: DataFrame, *keep: str) -> DataFrame:
    """(q_id, keep, n_sentences, average_score) for every passage, also one without a sentence."""
    per = scores.groupBy("q_id").agg(
        F.count("*").alias("n_sentences"), nan_mean(F.col("score")).alias("average_score")
    )
    return passages.select("q_id", *keep).join(per, "q_id", "left").select(
        "q_id",
        *keep,
        F.coalesce("n_sentences", F.lit(0)).cast("bigint").alias("n_sentences"),
        F.coalesce("average_score", nan()).alias("average_score"),
    )


# ---- samples in the row -----------------------------------------------------------------

PairScorer = Callable[[Column, Column], Column]


def trigram_scorer(sentence: Column, sample: Column) -> Column:
    """Share of the sentence's distinct trigrams that the sample lacks; NULL without trigrams."""
    return tx.let(
        tx.trigrams(sentence),
        lambda t: F.try_divide(
            F.size(F.array_except(t, tx.trigrams(sample))).cast("double"), F.size(t).cast("double")
        ),
    )


def verdict_scorer(ask: Callable[[Column, Column], Column]) -> PairScorer:
    """A pair scorer from a judge asked whether the sample supports the sentence: yes 0, no 1, other 0.5."""

    def score(sentence: Column, sample: Column) -> Column:
        return tx.let(
            tx.verdict_class(ask(sentence, sample)),
            lambda v: F.when(v == "yes", F.lit(0.0)).when(v == "no", F.lit(1.0)).otherwise(F.lit(0.5)),
        )

    return score


SCORERS: dict[str, PairScorer] = {"trigram": trigram_scorer}


def register_scorer(name: str, scorer: PairScorer) -> None:
    """Add a pair scorer: two text Columns to a DOUBLE Column (a pandas UDF call will do)."""
    SCORERS[name] = scorer


def scorer_named(name: str) -> PairScorer:
    if name not in SCORERS:
        warnings.warn(f"no pair scorer {name!r}; using 'trigram'")
        return trigram_scorer
    return SCORERS[name]


def _mean_absent(sentence: Column, counted: Column) -> Column:
    """Mean absent share over ``counted``: STRUCT(text, copies) per distinct sample.

    A sentence that every sample holds as it stands lacks none of its trigrams, which then need not be listed.
    """
    low = F.lower(sentence)
    held = (F.length(low) >= 3) & (F.size(counted) > 0) & F.forall(counted, lambda s: F.contains(s["text"], low))

    def over(t: Column) -> Column:
        absent = F.aggregate(
            counted,
            F.lit(0).cast("bigint"),
            lambda acc, s: acc
            + s["copies"] * F.when(F.contains(s["text"], F.lower(sentence)), 0).otherwise(
                F.size(F.filter(t, lambda x: ~F.contains(s["text"], x)))
            ),
        )
        samples = F.aggregate(counted, F.lit(0).cast("bigint"), lambda acc, s: acc + s["copies"])
        return F.coalesce(F.try_divide(absent.cast("double"), (F.size(t) * samples).cast("double")), nan())

    return F.when(held, F.lit(0.0)).otherwise(tx.let(tx.trigrams(sentence), over))


def score_nested(rows: DataFrame) -> DataFrame:
    """Add sentences, sentence scores and their mean to rows that hold passage and samples.

    The generator returns a fixed number of samples per question, so the row stays small and
    the whole step is a projection: no shuffle. A sample drawn several times is searched once.
    """
    split = rows.withColumn("passage_sentences", tx.sentences(F.col("passage")))
    counted = tx.let(
        F.transform("samples", F.lower),
        lambda low: F.transform(
            F.array_distinct(low),
            lambda d: F.struct(
                d.alias("text"), F.size(F.filter(low, lambda x: x == d)).cast("bigint").alias("copies")
            ),
        ),
    )
    scored = split.withColumn(
        "sentence_scores",
        tx.let(counted, lambda c: F.transform("passage_sentences", lambda s: _mean_absent(s, c))),
    )
    return _with_average(scored)


def _with_average(scored: DataFrame) -> DataFrame:
    numbers = F.filter("sentence_scores", lambda s: ~F.isnan(s))
    mean = tx.let(
        numbers,
        lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v).cast("double")),
    )
    return scored.withColumn("average_score", F.coalesce(mean, nan())).withColumn(
        "hallucinated", tx.hallucinated(F.col("average_score"))
    )


def score_pairs(rows: DataFrame, scorer: str, key: str = "q_id") -> DataFrame:
    """(key, sent_idx, score) with a plugged-in pair scorer that must see each pair.

    ``rows`` carry the generator's fixed number of samples per question; a pair is scored as the
    row unfolds and only sums per sentence are shuffled.
    """
    fn = scorer_named(scorer)
    unfolded = rows.select(key, "samples", F.posexplode(tx.sentences(F.col("passage"))).alias("sent_idx", "sentence"))
    scored = unfolded.select(key, "sent_idx", "sentence", F.explode("samples").alias("sample")).select(
        key, "sent_idx", fn(F.col("sentence"), F.col("sample")).alias("s")
    )
    return scored.groupBy(key, "sent_idx").agg(nan_mean(F.col("s")).alias("score"))


# ---- split ------------------------------------------------------------------------------


def split(scored: DataFrame) -> DataFrame:
    """Doubtful questions first, then sound ones: one table with a flag and an order column."""
    flag = tx.hallucinated(F.col("average_score"))
    return scored.withColumn("hallucinated", flag).withColumn(
        "part_ord", F.when(F.col("hallucinated"), 0).otherwise(1)
    )
