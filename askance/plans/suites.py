"""Evaluation suites: re-scoring, perplexity, question answering, reading, sentiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import generate as g
from ..operators import judge as j
from ..operators import order, overlap, perplexity, prompts, scoring
from ..session import cut_lineage
from ..sources import store
from . import runs


def rescore(questions: DataFrame, model: g.Model, scorer: str = "trigram") -> DataFrame:
    """(q_id, after): new passages and samples for ``question``, scored again."""
    if scorer == "trigram":
        return runs.answer_and_score(questions, model, "bare").select("q_id", F.col("average_score").alias("after"))
    answered = g.with_text(questions, "passage", model, F.col("question"), g.PASSAGE)
    sampled = g.with_samples(answered, "samples", model, F.col("question"))
    scores = scoring.score_pairs(sampled, scorer)
    return scoring.passage_scores(questions, scores).select("q_id", F.col("average_score").alias("after"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Means of both scores and of their difference per run; NaN scores stay out of the means."""
    joined = before.join(after, "q_id")
    delta = F.col("after") - F.col("before")

    def mean(value):
        return F.avg(F.when(~F.isnan(value), value))

    return joined.groupBy("run_id").agg(
        F.count("*").alias("n"),
        mean(F.col("before")).alias("mean_before"),
        mean(F.col("after")).alias("mean_after"),
        mean(delta).alias("mean_delta"),
    )


def perplexity_texts(
    texts: DataFrame, key: str = "doc_id", sample: int | None = fixed.EVAL_SAMPLE, word_limit: int | None = fixed.EVAL_WORDS
) -> DataFrame:
    """The texts the suite measures: a seeded sample, stripped, one-character texts out, cut to
    the word limit. None leaves out the sampling or the cut."""
    rows = texts if sample is None else order.seeded_sample(texts, key, sample)
    rows = rows.select(key, tx.strip(F.col("text")).alias("text")).filter(F.length("text") > 1)
    return rows if word_limit is None else rows.withColumn("text", tx.cut_words(F.col("text"), word_limit))


def perplexity_suite(texts: DataFrame, model: perplexity.PairModel | DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """The suite's means as metric rows; by a stored table of costs also each text's values, by its key."""
    if isinstance(model, DataFrame):
        rows = cut_lineage(perplexity.stored_perplexities(cut_lineage(perplexity_texts(texts, key, **kw)), key, model))
        own = rows.withColumn("run_id", F.lit("perplexity"))
        logged = [store.indexed_metric(own, "perplexity", c, key, c, None) for c in ("token_ppl", "char_ppl", "word_ppl")]
        return reduce(DataFrame.unionByName, logged, _perplexity_means(rows))
    return _perplexity_means(perplexity.perplexities(perplexity_texts(texts, key, **kw), key, model))


def _perplexity_means(rows: DataFrame) -> DataFrame:
    wide = perplexity.means(rows).withColumn("run_id", F.lit("perplexity"))
    return store.metric_rows(wide, "perplexity", "", [c for c in wide.columns if c.startswith("mean_")])


def answer(rows: DataFrame, prompt: str, model: g.Model, preset: g.Preset = g.EVALUATION) -> DataFrame:
    return g.with_text(rows, "prediction", model, F.col(prompt), preset)


def qa_suite(rows: DataFrame, suite: str, prefix: str, judge: j.Judge = j.lexical_judge) -> DataFrame:
    """BLEU, ROUGE and judged accuracy of ``prediction`` against ``reference`` as metric rows.

    ``rows``: run_id, idx, prompt, prediction, reference. Means are per run; judge scores are also
    logged per row.
    """
    keys = ["run_id", "idx"]
    bleu = overlap.bleu(rows, run=["run_id"])
    bleu_columns = [c for c in bleu.columns if c != "run_id"]
    rouge = overlap.rouge(rows, keys)
    rouge_means = rouge.groupBy("run_id").agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")])
    judged = rows.select(
        *keys, judge(F.col("prompt"), F.col("reference"), F.col("prediction")).alias("verdict_text")
    ).withColumn("oracle_acc", tx.verdict_score(F.col("verdict_text")))
    return (
        store.metric_rows(bleu, suite, prefix, bleu_columns)
        .unionByName(store.metric_rows(rouge_means, suite, prefix, ["rouge1", "rouge2", "rougeL", "rougeLsum"]))
        .unionByName(store.indexed_metric(judged, suite, f"{prefix}oracle_acc", "idx", "oracle_acc", None))
        .unionByName(store.indexed_metric(judged, suite, f"{prefix}oracle_acc_text", "idx", None, "verdict_text"))
    )


def instruction_rows(rows: DataFrame, model: g.Model, sample: int | None = fixed.EVAL_SAMPLE, key: str = "idx") -> DataFrame:
    """Instruction set rows answered: ``rows`` hold idx, run_id, instruction, input, reference."""
    chosen = rows if sample is None else order.seeded_sample(rows, key, sample)
    shown = chosen.withColumn("prompt", prompts.instruction(F.col("instruction"), F.col("input")))
    return answer(shown, "prompt", model)


def reading_suite(rows: DataFrame, key: str, prefix: str = "squad_") -> DataFrame:
    """Exact match and F1 in percent as metric rows; ``rows``: key, prediction, answers."""
    per = overlap.squad(rows, key)
    wide = per.agg(
        (100 * F.avg("exact_match")).alias("exact_match"), (100 * F.avg("f1")).alias("f1")
    ).withColumn("run_id", F.lit("reading"))
    return store.metric_rows(wide, "squad", prefix, ["exact_match", "f1"])


def sentiment_suite(rows: DataFrame, prefix: str = "glue_sst2_") -> DataFrame:
    """Accuracy as a metric row; ``rows``: prediction (text), label."""
    wide = rows.agg(
        overlap.accuracy(overlap.positive_label(F.col("prediction")), F.col("label")).alias("accuracy")
    ).withColumn("run_id", F.lit("sentiment"))
    return store.metric_rows(wide, "sst2", prefix, ["accuracy"])


# ---- suites end to end: prompt, generate, measure, judge ---------------------------------------


def instruction_run(
    rows: DataFrame, model: g.Model, judge: j.Judge = j.lexical_judge, sample: int | None = fixed.EVAL_SAMPLE
) -> DataFrame:
    """The instruction suite from its set (``instruction_rows``) to metric rows: BLEU, ROUGE, judged accuracy.

    Answers are stored before they are measured, so that each is generated once.
    """
    answered = instruction_rows(rows, model, sample).select("run_id", "idx", "prompt", "prediction", "reference")
    return qa_suite(cut_lineage(answered), "benchmark", "benchmark_", judge)


def reading_run(rows: DataFrame, model: g.Model, key: str = "idx", judge: j.Judge = j.lexical_judge) -> DataFrame:
    """The reading suite: ``rows`` (key, question, context, answers) are asked, answered, measured and judged.

    The judge sees the bare question and all right answers, joined by a comma. Exact match and F1 are means in
    percent; verdicts and their scores are logged per row.
    """
    shown = rows.withColumn("prompt", prompts.reading(F.col("question"), F.col("context")))
    answered = cut_lineage(answer(shown, "prompt", model, g.LONG_EVALUATION).select(key, "question", "answers", "prediction"))
    gold = F.array_join("answers", ", ")
    judged = answered.select(
        F.lit("reading").alias("run_id"), key, judge(F.col("question"), gold, F.col("prediction")).alias("verdict_text")
    ).withColumn("oracle_acc", tx.verdict_score(F.col("verdict_text")))
    return (
        reading_suite(answered, key)
        .unionByName(store.indexed_metric(judged, "squad", "squad_oracle_acc", key, "oracle_acc", None))
        .unionByName(store.indexed_metric(judged, "squad", "squad_oracle_acc_text", key, None, "verdict_text"))
    )


def sentiment_run(rows: DataFrame, model: g.Model) -> DataFrame:
    """The sentiment suite: ``rows`` (sentence, label) are asked and answered; accuracy as a metric row."""
    shown = rows.withColumn("prompt", prompts.sentiment(F.col("sentence")))
    return sentiment_suite(answer(shown, "prompt", model, g.LONG_EVALUATION).select("prediction", "label"))
