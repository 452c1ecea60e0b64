"""Pages for a question, and the answer and summary read from each page.

A page's score for a question is the summed rarity of the distinct words they share; the best ten
pages by (score, page number) are the question's links. A word's rarity is ln((pages + 1) / df) in
whole millionths, so sums do not depend on their order.

The list is exact, but no question meets every page that shares a word with it. Ten pages at least
reach the rarity of a question's rarest word held by ten or more. Its commonest words, as long as
their rarities sum to less than that, cannot bring in a page on their own: only the other words
fetch candidates. Candidates that could not reach the tenth best even with all the common words are
left, and the common words are looked up for the rest alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..session import cut_lineage
from .order import first_per_group
from .summary import ranked_summary

LINKS = 10
MILLIONTHS = 1_000_000

# A search function maps questions (q_id, prompt) to links (q_id, page_id, url, rank, ...).
Search = Callable[[DataFrame], DataFrame]


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(tx.lexical_tokens(F.col(text)))).alias("word"))


def _fetching(wanted: DataFrame, held: DataFrame, n_pages: Column, links: int) -> DataFrame:
    """(q_id, word, weight, fetches): a question's words that pages hold, and whether each brings candidates."""
    frequency = held.groupBy("word").agg(F.count("*").alias("df"))
    rarity = F.round(F.ln((n_pages + 1).cast("double") / F.col("df")) * MILLIONTHS).cast("bigint")
    terms = wanted.join(frequency.withColumn("weight", rarity), "word")
    question = Window.partitionBy("q_id")
    lightest_first = question.orderBy("weight", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.max(F.when(F.col("df") >= links, F.col("weight"))).over(question)
    so_far = F.sum("weight").over(lightest_first)
    return terms.select("q_id", "word", "weight", F.coalesce(so_far >= reached, F.lit(True)).alias("fetches"))


def lexical_search(pages: DataFrame, links: int = LINKS) -> Search:
    """The default search over a page table (page_id, url, full_text)."""

    def search(questions: DataFrame) -> DataFrame:
        wanted = _words(questions, "q_id", "prompt")
        # Only words that are asked for leave the scan; a word of a third of all pages is counted per task first.
        held = _words(pages, "page_id", "full_text").join(wanted.select("word").distinct(), "word", "left_semi")
        terms = _fetching(wanted, held, pages.agg(F.count("*")).scalar(), links)
        found = terms.filter("fetches").join(held, "word").groupBy("q_id", "page_id").agg(F.sum("weight").alias("sure"))
        common = terms.filter(~F.col("fetches"))
        rest = common.groupBy("q_id").agg(F.sum("weight").alias("rest"))
        tenth = (
            first_per_group(found, ["q_id"], [F.col("sure").desc(), F.col("page_id")], links)
            .filter(F.col("rank") == links)
            .select("q_id", F.col("sure").alias("tenth"))
        )
        near = (
            found.join(rest, "q_id", "left")
            .join(tenth, "q_id", "left")
            .filter(F.col("tenth").isNull() | (F.col("sure") + F.coalesce("rest", F.lit(0)) >= F.col("tenth")))
            .select("q_id", "page_id", "sure")
        )
        more = near.join(common, "q_id").join(held, ["page_id", "word"]).select("q_id", "page_id", "weight")
        scored = (
            near.withColumnRenamed("sure", "weight").unionByName(more).groupBy("q_id", "page_id").agg(F.sum("weight").alias("total"))
        )
        ranked = first_per_group(scored, ["q_id"], [F.col("total").desc(), F.col("page_id")], links)
        return ranked.join(pages.select("page_id", "url"), "page_id").select(
            "q_id", "page_id", "url", F.col("rank").cast("int").alias("rank"),
            (F.col("total") / float(MILLIONTHS)).alias("score"),
        )

    return search


def best_sentence(prompt: Column, sentences: Column, tokens: Column) -> Column:
    """STRUCT(text, score): the page sentence with most of the prompt's distinct words, the earliest
    on a tie; the score is the share of those words. NULL text when nothing is shared.

    ``tokens`` holds each sentence's words, made once per page."""

    def over(asked: Column) -> Column:
        return tx.let(
            F.transform(tokens, lambda t: F.size(F.array_intersect(asked, t))),
            lambda c: F.struct(
                F.when(F.array_max(c) > 0, F.get(sentences, (F.array_position(c, F.array_max(c)) - 1).cast("int"))).alias("text"),
                F.coalesce(F.try_divide(F.array_max(c).cast("double"), F.size(asked).cast("double")), F.lit(0.0)).alias("score"),
            ),
        )

    return tx.let(F.array_distinct(tx.lexical_tokens(prompt)), over)


def lead_summary(text: Column, longest: int = fixed.SUMMARY_MAX_WORDS) -> Column:
    """The leading words, up to the summary's length limit."""
    return F.array_join(F.slice(tx.words(text), 1, longest), " ")


def curate(
    questions: DataFrame, pages: DataFrame, search: Search, summarize: Callable[[Column], Column] = ranked_summary
) -> DataFrame:
    """One row per (question, linked page) with answer, summary, text and score.

    Sentences, their words and the summary are made once per linked page, before the join; rows without an answer stay
    here with a NULL ``answer_text`` and are taken apart by ``succeeded`` / ``failed``.
    """
    links = cut_lineage(search(questions).select("q_id", "page_id", "rank"))
    linked = pages.join(links.select("page_id").distinct(), "page_id", "left_semi")
    read = linked.select(
        "page_id",
        F.col("url").alias("source_url"),
        "full_text",
        tx.sentences(F.col("full_text")).alias("_sentences"),
        summarize(F.col("full_text")).alias("summary_text"),
    ).withColumn("_tokens", F.transform("_sentences", tx.lexical_tokens))
    rows = links.join(questions.select("q_id", "prompt"), "q_id").join(read, "page_id")
    best = best_sentence(F.col("prompt"), F.col("_sentences"), F.col("_tokens"))
    return rows.withColumn("_best", best).select(
        "q_id", "page_id", "rank", "prompt",
        F.col("_best.text").alias("answer_text"),
        F.when(F.length("summary_text") > 0, F.col("summary_text")).alias("summary_text"),
        "full_text",
        F.col("_best.score").alias("answer_score"),
        "source_url",
    )


def succeeded(curated: DataFrame) -> DataFrame:
    return curated.filter(F.col("answer_text").isNotNull())


def failed(curated: DataFrame) -> DataFrame:
    return curated.filter(F.col("answer_text").isNull()).select("q_id", "page_id", "source_url")
