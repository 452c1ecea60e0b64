"""From doubtful questions to training frames and preference pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import judge as j
from ..operators import pairs, retrieval
from ..session import cut_lineage


def from_pages(
    questions: DataFrame,
    pages: DataFrame,
    scored: DataFrame,
    search: retrieval.Search | None = None,
    judge: j.Judge = j.lexical_judge,
    relevance: Callable[[Column, Column], Column] = j.lexical_relevance,
) -> DataFrame:
    """Training frame from pages: search, read, clean, judge relevance, join passages, judge agreement.

    A question asked many times is searched once: its pages meet each of its passages, so rows grow
    with the passages and not with their square.
    """
    once = questions.groupBy("prompt").agg(F.min("q_id").alias("q_id"))
    found = retrieval.curate(once, pages, search or retrieval.lexical_search(pages))
    docs = retrieval.succeeded(found).select(
        "prompt", F.col("answer_score").cast("double").alias("answer_score"), "answer_text", "summary_text", "full_text", "source_url"
    )
    docs = pairs.clean_text(docs, ["prompt", "answer_text", "summary_text", "full_text"])
    docs = docs.withColumn("LLM_judge_relevance", relevance(F.col("prompt"), F.col("full_text")))
    return pairs.training_frame(docs, scored, judge)


def from_answers(answers: DataFrame, scored: DataFrame, judge: j.Judge = j.lexical_judge) -> DataFrame:
    """Training frame from a stronger answerer: one answer per distinct prompt, then cleaned and joined."""
    docs = pairs.clean_text(answers.select("prompt", "answer_text"), ["prompt", "answer_text"])
    return pairs.training_frame(docs, scored, judge)


def from_doubtful(
    scored: DataFrame, answer: Callable[[Column], Column], judge: j.Judge = j.lexical_judge
) -> DataFrame:
    """Training frame of the doubtful questions of ``scored`` alone: each distinct one is answered once.

    The doubtful rows come back in the answers and on either side of the join, so they are stored in
    the shared folder once rather than scored three times.
    """
    doubtful = cut_lineage(scored.filter("hallucinated").select("prompt", "passage"))
    return from_answers(j.stronger_answers(doubtful, answer), doubtful, judge)


def rejudge(train: DataFrame, judge: j.Judge = j.lexical_judge) -> DataFrame:
    """A stored training frame with its agreement judged anew."""
    verdict = judge(F.col("prompt"), F.col("answer_text"), F.coalesce("passage", F.lit("-")))
    scored = train.withColumn("similarity_text", verdict)
    return scored.withColumn("similarity", tx.verdict_score(F.col("similarity_text")))
