"""Queries that build training frames and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import judge, pairs, retrieval, summary, tokens
from ..session import cut_lineage
from ..sources import tables as t
from . import training, views
from .queries_text import S_VERDICT_SCORE, s_page_text, s_token_ids
from .registry import PAIRS, QUESTIONS, SCORES, query, r6, s_fill, s_sentences, s_strip, s_tokens, s_words


def _known(spark, sf):
    """One known answer per prompt."""
    return t.qa_pairs(spark, sf).groupBy("prompt").agg(F.min("passage").alias("answer_text"))


@query("stronger_answers", f"WITH {PAIRS} SELECT prompt, min(passage) AS answer_text FROM qa GROUP BY 1")
def stronger_answers(spark, sf):
    return judge.answers_from_table(t.questions(spark, sf), _known(spark, sf))


def _echoed(spark, sf):
    return judge.stronger_answers(t.questions(spark, sf), lambda p: F.concat(p, F.lit("...")))


_TRAIN = (
    f"{PAIRS}, {QUESTIONS}, pr AS (SELECT {s_strip('prompt')} AS prompt, {s_strip('passage')} AS passage FROM qa), "
    f"an AS (SELECT {s_strip('prompt')} AS prompt, {s_strip('answer')} AS answer_text FROM "
    "(SELECT DISTINCT prompt, prompt || '...' AS answer FROM q)), "
    "tr AS (SELECT an.prompt, answer_text, passage FROM an LEFT JOIN pr USING (prompt))"
)


@query("train_join", f"WITH {_TRAIN} SELECT * FROM tr")
def train_join(spark, sf):
    docs = pairs.clean_text(_echoed(spark, sf), ["prompt", "answer_text"])
    return pairs.left_join_skewed(docs, pairs.predictions(t.qa_pairs(spark, sf)), "prompt").select("prompt", "answer_text", "passage")


def s_judge(gold: str, answer: str) -> str:
    a, b = f"list_distinct({s_tokens(gold)})", f"list_distinct({s_tokens(answer)})"
    return (
        f"(SELECT CASE WHEN f >= 0.8 THEN 'YES' WHEN f >= 0.3 THEN 'PARTLY' ELSE 'NO' END FROM "
        f"(SELECT coalesce(2.0 * len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}), 0), 0) AS f))"
    )


_PASSAGE = "coalesce(passage, '-')"
_AGREE = "CASE similarity_text WHEN 'YES' THEN 1.0 WHEN 'PARTLY' THEN 0.5 ELSE 0.0 END::DOUBLE"


@query(
    "train_from_answers",
    f"WITH {_TRAIN}, jd AS (SELECT *, {s_judge('answer_text', _PASSAGE)} AS similarity_text FROM tr) "
    f"SELECT prompt, answer_text, passage, similarity_text, {_AGREE} AS similarity FROM jd",
)
def train_from_answers(spark, sf):
    frame = training.from_answers(_echoed(spark, sf), t.qa_pairs(spark, sf))
    return frame.select("prompt", "answer_text", "passage", "similarity_text", "similarity")


_DOUBTFUL = (
    f"{SCORES}, dq AS (SELECT prompt, passage FROM sc WHERE hallucinated), "
    f"dp AS (SELECT {s_strip('prompt')} AS prompt, {s_strip('passage')} AS passage FROM dq), "
    f"an AS (SELECT {s_strip('prompt')} AS prompt, {s_strip('answer')} AS answer_text FROM "
    "(SELECT DISTINCT prompt, prompt || '...' AS answer FROM dq)), "
    "tr AS (SELECT an.prompt, answer_text, passage FROM an LEFT JOIN dp USING (prompt)), "
    f"jd AS (SELECT *, {s_judge('answer_text', _PASSAGE)} AS similarity_text FROM tr), "
    f"fr AS (SELECT prompt, answer_text, passage, similarity_text, {_AGREE} AS similarity FROM jd)"
)


def _doubtful(spark, sf):
    return training.from_doubtful(views.scored(spark, sf), lambda p: F.concat(p, F.lit("...")))


@query("train_from_doubtful", f"WITH {_DOUBTFUL} SELECT * FROM fr")
def train_from_doubtful(spark, sf):
    """Scored questions to the training frame of the doubtful ones."""
    return _doubtful(spark, sf).select("prompt", "answer_text", "passage", "similarity_text", "similarity")


@query(
    "doubtful_preferences",
    f"WITH {_DOUBTFUL} SELECT "
    + s_fill(fixed.TEMPLATES[0][1] + "{prompt}" + fixed.TEMPLATES[0][2], prompt="prompt")
    + f" AS prompt, {s_strip(f'CASE WHEN similarity > 0.5 THEN {_PASSAGE} ELSE answer_text END')} AS chosen, "
    f"{s_strip(f'CASE WHEN similarity > 0.5 THEN chr(45) ELSE {_PASSAGE} END')} AS rejected FROM fr",
)
def doubtful_preferences(spark, sf):
    """Scored questions to the preference pairs of the doubtful ones."""
    return pairs.preference_pairs(_doubtful(spark, sf), tx.render(fixed.TEMPLATES[0][0]))


def _judged_documents(spark, sf):
    """Labelled documents as a training frame: the document is the answer, its echo the passage."""
    docs = t.table(spark, sf, "documents").join(t.verdicts(spark, sf), "doc_id")
    return docs.select(
        "doc_id",
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("prompt"),
        F.col("text").alias("answer_text"),
        F.concat(F.lit("  "), "text", F.lit("...\n")).alias("passage"),
        tx.verdict_score(F.col("verdict_text")).alias("similarity"),
    )


_PREFS = (
    f"pp AS (SELECT doc_id, '### System:' || chr(10) || 'You are a student who is eager to learn about new things.' || chr(10) || "
    "'### User:' || chr(10) || source || ':' || doc_id || chr(10) || '### Assistant:' || chr(10) AS prompt, "
    f"{s_strip('CASE WHEN sim > 0.5 THEN passage ELSE text END')} AS chosen, "
    f"{s_strip('CASE WHEN sim > 0.5 THEN chr(45) ELSE passage END')} AS rejected FROM (SELECT d.*, "
    f"'  ' || text || '...' || chr(10) AS passage, {S_VERDICT_SCORE} AS sim FROM documents d JOIN labels l ON l.doc_id = d.doc_id))"
)


def _preferences(spark, sf):
    return pairs.preference_pairs(_judged_documents(spark, sf), tx.render("Intel/neural-chat-7b-v3-3"), "doc_id")


@query("preference_pairs", f"WITH {_PREFS} SELECT * FROM pp")
def preference_pairs(spark, sf):
    return _preferences(spark, sf)


@query(
    "pair_length_budget",
    f"WITH {_PREFS}, i AS (SELECT doc_id, {s_token_ids('prompt')} AS p, {s_token_ids('chosen')} AS c, {s_token_ids('rejected')} AS r FROM pp), "
    "o AS (SELECT *, len(p) + greatest(len(c), len(r)) > 512 AS over_budget FROM i), "
    "k AS (SELECT *, CASE WHEN over_budget THEN p[greatest(len(p) - 255, 1):] ELSE p END AS kp FROM o), "
    "s AS (SELECT *, len(kp) + greatest(len(c), len(r)) > 512 AS still FROM k) SELECT doc_id, over_budget, "
    "array_to_string(kp, ' ') AS prompt_ids, array_to_string(CASE WHEN still THEN c[:256] ELSE c END, ' ') AS chosen_ids, "
    "array_to_string(CASE WHEN still THEN r[:256] ELSE r END, ' ') AS rejected_ids FROM s",
)
def pair_length_budget(spark, sf):
    cut = tokens.length_budget(_preferences(spark, sf), "prompt", "chosen", "rejected")
    names = ["prompt_ids", "chosen_ids", "rejected_ids"]
    return cut.select("doc_id", "over_budget", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in names])


# ---- pages --------------------------------------------------------------------------------


def _pages(spark, sf):
    """Pages parsed once and stored: search, reading and links all come back to them."""
    return cut_lineage(t.pages(spark, sf))


def _asked(spark, sf):
    return t.table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("prompt"))


_PAGE_TEXTS = f"pg AS (SELECT * FROM (SELECT page_id, url, {s_page_text('html')} AS full_text FROM pages) WHERE full_text <> '')"

# The check sums every shared word of every pair; the query fetches candidates by the rarer words.
_LINKS = (
    f"{_PAGE_TEXTS}, pw AS (SELECT page_id, unnest(list_distinct({s_tokens('full_text')})) AS w FROM pg), "
    "fr AS (SELECT w, round(ln(((SELECT count(*) FROM pg) + 1)::DOUBLE / count(*)) * 1000000)::BIGINT AS weight FROM pw GROUP BY 1), "
    f"qw AS (SELECT item_id AS q_id, unnest(list_distinct({s_tokens('text')})) AS w FROM benchmark), "
    "hit AS (SELECT q_id, page_id, sum(weight)::BIGINT AS total FROM qw JOIN pw USING (w) JOIN fr USING (w) GROUP BY 1, 2), "
    "ln AS (SELECT q_id, page_id, row_number() OVER (PARTITION BY q_id ORDER BY total DESC, page_id)::INT AS rank, total FROM hit QUALIFY rank <= 10)"
)


@query("retrieve_pages", f"WITH {_LINKS} SELECT q_id, page_id, url, rank, round(total / 1000000.0::DOUBLE, 6)::DOUBLE AS score FROM ln JOIN pg USING (page_id)")
def retrieve_pages(spark, sf):
    return retrieval.lexical_search(_pages(spark, sf))(_asked(spark, sf)).withColumn("score", r6("score"))


def _s_ranks() -> str:
    """The rounds of sentence ranks, one table after another."""
    share = "CASE WHEN links > 0 THEN r // links ELSE 0 END"
    parts = []
    for i in range(summary.ROUNDS):
        parts.append(f"h{i} AS MATERIALIZED (SELECT *, {share} AS sh FROM r{i})")
        parts.append(
            f"g{i} AS MATERIALIZED (SELECT page_id, pos, sum(t) AS t FROM sx JOIN (SELECT page_id, w, sum(sh) AS t FROM sx JOIN h{i} "
            "USING (page_id, pos) GROUP BY 1, 2) USING (page_id, w) GROUP BY 1, 2)"
        )
        flow = f"{summary.UNIT * (100 - summary.FLOW_PERCENT) // 100} + ({summary.FLOW_PERCENT} * (coalesce(t, 0) - own * sh)) // 100"
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT page_id, pos, own, links, ({flow})::BIGINT AS r FROM h{i} LEFT JOIN g{i} USING (page_id, pos))"
        )
    return ", ".join(parts)


# Page, sentence and word as rows; links are counted by the holders of each word.
_SUMMARIES = (
    f"ss AS MATERIALIZED (SELECT page_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT page_id, {s_sentences('full_text')} AS s FROM pg)), "
    f"sx AS MATERIALIZED (SELECT page_id, pos, unnest(list_distinct({s_tokens('sentence')})) AS w FROM ss), "
    "hw AS (SELECT page_id, w, count(*) AS c FROM sx GROUP BY 1, 2), "
    "dg AS (SELECT page_id, pos, count(*) AS own, sum(c - 1)::BIGINT AS links FROM sx JOIN hw USING (page_id, w) GROUP BY 1, 2), "
    f"r0 AS MATERIALIZED (SELECT page_id, pos, coalesce(own, 0) AS own, coalesce(links, 0) AS links, {summary.UNIT}::BIGINT AS r FROM ss LEFT JOIN dg USING (page_id, pos)), "
    f"{_s_ranks()}, "
    f"so AS (SELECT page_id, pos, sentence, {s_words('sentence')} AS ws, count(*) OVER (PARTITION BY page_id) AS n, "
    f"row_number() OVER (PARTITION BY page_id ORDER BY r DESC, pos) AS k FROM ss JOIN r{summary.ROUNDS} USING (page_id, pos)), "
    "sk AS (SELECT *, sum(len(ws)) OVER (PARTITION BY page_id ORDER BY k) AS words FROM so), "
    f"sm AS (SELECT page_id, coalesce(string_agg(sentence, ' ' ORDER BY pos) FILTER (k <= (n + {summary.ONE_IN - 1}) // {summary.ONE_IN} AND words <= {fixed.SUMMARY_MAX_WORDS}), "
    f"any_value(array_to_string(ws[:{fixed.SUMMARY_MAX_WORDS}], ' ')) FILTER (k = 1)) AS summary_text FROM sk GROUP BY 1)"
)

@query("page_summaries", f"WITH {_PAGE_TEXTS}, {_SUMMARIES} SELECT page_id, summary_text FROM sm")
def page_summaries(spark, sf):
    """Every page's summary: its best sentences by shared words, in page order."""
    return t.pages(spark, sf).select("page_id", summary.ranked_summary(F.col("full_text")).alias("summary_text"))


_CURATED = (
    f"{_LINKS}, {_SUMMARIES}, se AS (SELECT page_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM "
    f"(SELECT page_id, {s_sentences('full_text')} AS s FROM pg)), "
    f"sw AS (SELECT page_id, sentence, pos, list_distinct({s_tokens('sentence')}) AS w FROM se), "
    f"qs AS (SELECT item_id AS q_id, text AS prompt, list_distinct({s_tokens('text')}) AS w FROM benchmark), "
    "bs AS (SELECT q_id, page_id, prompt, sentence, len(list_intersect(qs.w, sw.w)) AS n, len(qs.w) AS m FROM ln JOIN qs USING (q_id) "
    "JOIN sw USING (page_id) QUALIFY row_number() OVER (PARTITION BY q_id, page_id ORDER BY n DESC, pos) = 1), "
    "cu AS (SELECT q_id, page_id, prompt, sentence AS answer_text, n::DOUBLE / m AS answer_score, "
    "summary_text, full_text, url AS source_url FROM bs JOIN pg USING (page_id) JOIN sm USING (page_id) WHERE n > 0)"
)


@query(
    "curate_pages",
    f"WITH {_CURATED} SELECT q_id, page_id, prompt, answer_text, round(answer_score, 6) AS answer_score, summary_text, "
    "full_text, source_url FROM cu",
)
def curate_pages(spark, sf):
    pages = _pages(spark, sf)
    found = retrieval.succeeded(retrieval.curate(_asked(spark, sf), pages, retrieval.lexical_search(pages)))
    return found.drop("rank").withColumn("answer_score", r6("answer_score"))


@query(
    "train_from_pages",
    f"WITH {_CURATED}, b AS (SELECT {s_strip('text')} AS prompt, {s_strip('text')} || '...' AS passage FROM benchmark), "
    f"cl AS (SELECT {s_strip('prompt')} AS prompt, {s_strip('answer_text')} AS answer_text, {s_strip('full_text')} AS full_text, "
    "answer_score, source_url FROM cu), "
    f"jd AS (SELECT cl.*, passage, {s_judge('answer_text', 'passage')} AS similarity_text, "
    f"len(list_intersect(list_distinct({s_tokens('cl.prompt')}), {s_tokens('full_text')})) / len(list_distinct({s_tokens('cl.prompt')}))::DOUBLE AS sh "
    "FROM cl LEFT JOIN b USING (prompt)) "
    "SELECT prompt, answer_text, round(answer_score, 6) AS answer_score, source_url, passage, "
    "CASE WHEN sh >= 0.5 THEN 'YES' WHEN sh >= 0.2 THEN 'PARTLY' ELSE 'NO' END AS \"LLM_judge_relevance\", similarity_text, "
    f"{_AGREE} AS similarity FROM jd",
)
def train_from_pages(spark, sf):
    asked = _asked(spark, sf)
    scored = asked.select("prompt", F.concat(tx.strip(F.col("prompt")), F.lit("...")).alias("passage"))
    frame = training.from_pages(asked, _pages(spark, sf), scored)
    return frame.withColumn("answer_score", r6("answer_score")).select(
        "prompt", "answer_text", "answer_score", "source_url", "passage", "LLM_judge_relevance", "similarity_text", "similarity"
    )


@query(
    "judged_by_batches",
    f"WITH {PAIRS}, m AS (SELECT q_id, length({s_fill(fixed.ACCURACY_MESSAGE, prompt='prompt', gold='passage', answer='prompt')}) % 3 AS k FROM qa) "
    "SELECT q_id, ['Yes.', 'Partly', 'No'][k + 1] AS verdict_text, (2 - k) / 2.0::DOUBLE AS score FROM m",
)
def judged_by_batches(spark, sf):
    """Verdicts of a judge that is loaded once per Python worker and sees batches of messages."""

    def load():
        return lambda system, user: [["Yes.", "Partly", "No"][len(u) % 3] for u in user]

    decide = judge.batch_judge(load, "verdict by length")
    rows = t.qa_pairs(spark, sf).select("q_id", decide(F.col("prompt"), F.col("passage"), F.col("prompt")).alias("verdict_text"))
    return rows.withColumn("score", tx.verdict_score(F.col("verdict_text")))
