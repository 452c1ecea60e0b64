"""Queries that measure texts against references and models."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import generate as g
from ..operators import overlap, perplexity
from ..session import shared_folder
from ..sources import tables as t
from . import suites
from .queries_scoring import rounded
from .queries_text import S_CUT
from .queries_training import s_judge
from .registry import PAIRS, lit, query, r6, s_fill, s_sentences, s_strip, s_words

_PPL_COLUMNS = ["nll", "token_ppl", "char_ppl", "word_ppl"]
_PPL = (
    f"tx AS (SELECT doc_id, {s_strip('text')} AS text FROM documents WHERE length({s_strip('text')}) > 1), "
    f"ws AS (SELECT doc_id, text, {s_words('text')} AS w FROM tx), "
    "wd AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM ws), "
    "pr AS (SELECT doc_id, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, w AS w2 FROM wd QUALIFY w1 IS NOT NULL), "
    "c2 AS (SELECT w1, w2, count(*) AS c FROM pr GROUP BY 1, 2), c1 AS (SELECT w1, count(*) AS c1 FROM pr GROUP BY 1), "
    "vo AS (SELECT count(DISTINCT w) AS v FROM wd), "
    f"nl AS (SELECT doc_id, sum(-ln((c + {perplexity.SMOOTHING}::DOUBLE) / (c1 + {perplexity.SMOOTHING}::DOUBLE * v))) AS nll FROM pr "
    "JOIN c2 USING (w1, w2) JOIN c1 USING (w1), vo GROUP BY 1), "
    "pp AS (SELECT doc_id, length(text)::BIGINT AS chars, len(w)::BIGINT AS words, nll, exp(nll / (len(w) - 1)) AS token_ppl, "
    "exp(nll / length(text)) AS char_ppl, exp(nll / len(w)) AS word_ppl FROM ws JOIN nl USING (doc_id) WHERE len(w) >= 2)"
)


def _perplexities(spark, sf):
    documents = t.spread(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    texts = suites.perplexity_texts(documents, sample=None, word_limit=None)
    return perplexity.own_perplexities(texts, "doc_id")


@query(
    "perplexity_rows",
    f"WITH {_PPL} SELECT doc_id, chars, words, " + ", ".join(f"round({c}, 4) AS {c}" for c in _PPL_COLUMNS) + " FROM pp",
)
def perplexity_rows(spark, sf):
    return _perplexities(spark, sf).withColumns({c: F.round(c, 4) for c in _PPL_COLUMNS})


@query(
    "perplexity_means",
    f"WITH {_PPL} SELECT count(*) AS n_texts, "
    + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in ["chars", "words", *_PPL_COLUMNS])
    + " FROM pp",
)
def perplexity_means(spark, sf):
    out = perplexity.means(_perplexities(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("mean_")})


# ---- predictions: the question, then the answer's sentences in reverse ---------------------


def _predicted(spark, sf):
    turned = F.array_join(F.reverse(tx.sentences(F.col("passage"))), "\n")
    return t.qa_pairs(spark, sf, spread_out=True).select(
        F.col("turn").cast("string").alias("run_id"), F.col("q_id").alias("idx"), "prompt",
        F.concat("prompt", F.lit("\n"), turned).alias("prediction"), F.col("passage").alias("reference"),
    )


_PREDICTED = (
    f"{PAIRS}, pd AS (SELECT turn::VARCHAR AS run_id, q_id AS idx, prompt, prompt || chr(10) || "
    f"array_to_string(list_reverse({s_sentences('passage')}), chr(10)) AS prediction, passage AS reference FROM qa)"
)


def s_bleu_tokens(x: str) -> str:
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    x = f"' ' || {x} || ' '"
    for pattern, to in fixed.BLEU_TOKEN_RULES:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(to.replace('$', chr(92)))}, 'g')"
    return s_words(x)


def s_rouge_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _s_counts(order: int) -> str:
    """Clipped n-gram matches over token lists p and g of table tk (run_id, idx, p, g)."""
    grams = " UNION ALL ".join(
        f"SELECT run_id, idx, {n} AS n, unnest(list_transform(generate_series(1, len({s}) - {n - 1}), "
        f"lambda i: array_to_string({s}[i:i + {n - 1}], ' '))) AS gram, {int(s == 'p')} AS p FROM tk"
        for n in range(1, order + 1)
        for s in ("p", "g")
    )
    return f"gr AS ({grams}), ct AS (SELECT run_id, idx, n, gram, sum(p) AS a, sum(1 - p) AS b FROM gr GROUP BY 1, 2, 3, 4)"


_BLEU_SUMS = ", ".join(
    f"coalesce(sum(least(a, b)) FILTER (n = {n}), 0)::DOUBLE / nullif(sum(a) FILTER (n = {n}), 0) AS precision_{n}" for n in range(1, 5)
)


@query(
    "bleu",
    f"WITH {_PREDICTED}, tk AS (SELECT run_id, idx, {s_bleu_tokens('prediction')} AS p, {s_bleu_tokens('reference')} AS g FROM pd), "
    f"{_s_counts(4)}, t AS (SELECT run_id, {_BLEU_SUMS}, sum(a) FILTER (n = 1) AS tl, sum(b) FILTER (n = 1) AS rl FROM ct GROUP BY 1), "
    "u AS (SELECT *, tl::DOUBLE / rl AS ratio, CASE WHEN tl > rl THEN 1.0 ELSE exp(1 - rl::DOUBLE / tl) END::DOUBLE AS bp FROM t) "
    "SELECT run_id, round(CASE WHEN precision_4 > 0 THEN bp * exp((ln(precision_1) + ln(precision_2) + ln(precision_3) + ln(precision_4)) / 4) "
    "ELSE 0 END, 6) AS bleu, " + ", ".join(f"round(coalesce(precision_{n}, 0), 6) AS precision_{n}" for n in range(1, 5))
    + ", round(bp, 6) AS brevity_penalty, round(ratio, 6) AS length_ratio, tl::BIGINT AS translation_length, rl::BIGINT AS reference_length FROM u",
)
def bleu(spark, sf):
    out = overlap.bleu(_predicted(spark, sf), run=["run_id"])
    return rounded(out, ["bleu", "precision_1", "precision_2", "precision_3", "precision_4", "brevity_penalty", "length_ratio"])


def _s_f(n: int) -> str:
    return (
        f"round(coalesce(2.0 * sum(least(a, b)) FILTER (n = {n}) / nullif(sum(a + b) FILTER (n = {n}), 0), 0), 6)::DOUBLE AS rouge{n}"
    )


@query(
    "rouge_n",
    f"WITH {_PREDICTED}, tk AS (SELECT run_id, idx, {s_rouge_tokens('prediction')} AS p, {s_rouge_tokens('reference')} AS g FROM pd), "
    f"{_s_counts(2)}, f AS (SELECT run_id, idx, {_s_f(1)}, {_s_f(2)} FROM ct GROUP BY 1, 2) "
    "SELECT run_id, idx, coalesce(rouge1, 0) AS rouge1, coalesce(rouge2, 0) AS rouge2 FROM pd LEFT JOIN f USING (run_id, idx)",
)
def rouge_n(spark, sf):
    return rounded(overlap.rouge_n(_predicted(spark, sf), ["run_id", "idx"]), ["rouge1", "rouge2"])


@query("rouge_l")
def rouge_l(spark, sf):
    return rounded(overlap.rouge_l(_predicted(spark, sf), ["run_id", "idx"]), ["rougeL", "rougeLsum"])


@query("qa_suite")
def qa_suite(spark, sf):
    return suites.qa_suite(_predicted(spark, sf), "learned", "learned_").withColumn("value", r6("value"))


def s_answer_tokens(x: str) -> str:
    bare = f"regexp_replace(lower({x}), {lit(fixed.PUNCTUATION_CLASS)}, '', 'g')"
    return f"list_filter({s_words(bare)}, lambda w: w NOT IN ('a', 'an', 'the'))"


@query(
    "squad_em_f1",
    f"WITH {PAIRS}, r AS (SELECT q_id, prompt, {s_sentences('passage')} AS golds FROM qa), "
    "x AS (SELECT q_id, CASE WHEN length(prompt) % 2 = 0 THEN prompt ELSE 'The ' || golds[1] || '!' END AS pred, unnest(golds) AS gold, "
    "generate_subscripts(golds, 1) AS gi FROM r), "
    f"tk AS (SELECT q_id AS run_id, gi AS idx, {s_answer_tokens('pred')} AS p, {s_answer_tokens('gold')} AS g FROM x), "
    f"{_s_counts(1)}, f AS (SELECT run_id, idx, 2.0 * sum(least(a, b)) / sum(a + b) AS f1 FROM ct GROUP BY 1, 2) "
    "SELECT tk.run_id AS q_id, max((p = g)::INT)::DOUBLE AS exact_match, round(max(coalesce(f1, 0)), 6)::DOUBLE AS f1 "
    "FROM tk LEFT JOIN f ON f.run_id = tk.run_id AND f.idx = tk.idx GROUP BY 1",
)
def squad_em_f1(spark, sf):
    golds = F.col("golds")
    rows = t.qa_pairs(spark, sf, spread_out=True).select("q_id", "prompt", tx.sentences(F.col("passage")).alias("golds"))
    pred = F.when(F.length("prompt") % 2 == 0, F.col("prompt")).otherwise(F.concat(F.lit("The "), F.get(golds, 0), F.lit("!")))
    return rounded(overlap.squad(rows.select("q_id", pred.alias("prediction"), golds.alias("answers")), "q_id"), ["f1"])


@query(
    "sst2_accuracy",
    "SELECT 'sentiment' AS run_id, 'sst2' AS suite, 'glue_sst2_accuracy' AS metric, NULL::BIGINT AS idx, "
    "round(avg((toxic = 0 AND quality = 1 OR toxic = 1 AND quality = 0)::INT), 6) AS value, NULL::VARCHAR AS text FROM labels",
)
def sst2_accuracy(spark, sf):
    text = F.when(F.col("toxic") == 0, "I find it POSITIVE.").otherwise("Positive? No: NEGATIVE.")
    rows = t.table(spark, sf, "labels").select(text.alias("prediction"), F.col("quality").alias("label"))
    return suites.sentiment_suite(rows).withColumn("value", r6("value"))


# ---- suites end to end ------------------------------------------------------------------------

_K = f"{perplexity.SMOOTHING}::DOUBLE"
_STORED = (
    f"cw AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, {s_words('text')} AS ws FROM conversations)), "
    "cp AS (SELECT lag(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS w1, w AS w2 FROM cw QUALIFY w1 IS NOT NULL), "
    "c2 AS (SELECT w1, w2, count(*) AS c FROM cp GROUP BY 1, 2), fs AS (SELECT w1, sum(c) AS c1, count(*) AS t FROM c2 GROUP BY 1), "
    f"n1 AS (SELECT w AS w2, count(*) AS n FROM cw GROUP BY 1), tot AS (SELECT sum(n) + {_K} * (count(*) + 1) AS whole FROM n1), "
    "sd AS (SELECT doc_id, text FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 1000), "
    f"tx AS (SELECT doc_id, {S_CUT} AS text FROM (SELECT doc_id, {s_strip('text')} AS b FROM sd) WHERE length(b) > 1), "
    f"ws AS (SELECT doc_id, {s_strip('text')} AS text, {s_words('text')} AS w FROM tx), "
    "wd AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM ws), "
    "pr AS (SELECT doc_id, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, w AS w2 FROM wd QUALIFY w1 IS NOT NULL), "
    f"pp AS (SELECT doc_id, c, c1, t, (coalesce(n, 0) + {_K}) / whole AS p FROM pr LEFT JOIN c2 USING (w1, w2) LEFT JOIN fs USING (w1) LEFT JOIN n1 USING (w2), tot), "
    "nl AS (SELECT doc_id, sum(CASE WHEN c IS NOT NULL THEN -ln((c + t * p) / (c1 + t)) ELSE coalesce(-ln(t / (c1 + t)::DOUBLE), 0) - ln(p) END) AS nll FROM pp GROUP BY 1), "
    "pt AS (SELECT doc_id, length(text)::DOUBLE AS chars, len(w)::DOUBLE AS words, nll, exp(nll / (len(w) - 1)) AS token_ppl, "
    "exp(nll / length(text)) AS char_ppl, exp(nll / len(w)) AS word_ppl FROM ws JOIN nl USING (doc_id) WHERE len(w) >= 2)"
)


@query(
    "perplexity_suite",
    f"WITH {_STORED}, m AS ("
    + " UNION ALL ".join(f"SELECT 'mean_{c}' AS metric, NULL::BIGINT AS idx, avg({c}) AS x FROM pt" for c in ("chars", "words", *_PPL_COLUMNS))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', doc_id, {c} FROM pt" for c in _PPL_COLUMNS[1:])
    + ") SELECT 'perplexity' AS run_id, 'perplexity' AS suite, metric, idx, round(x, 4)::DOUBLE AS value, NULL::VARCHAR AS text FROM m",
)
def perplexity_suite(spark, sf):
    """The suite's thousand texts of at most 256 words, by a model of all conversation turns that is stored and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/costs-{uuid4().hex}"
    perplexity.write_costs(perplexity.fit_costs(t.table(spark, sf, "conversations").select("text")), path)
    texts = t.table(spark, sf, "documents").select("doc_id", "text")
    return suites.perplexity_suite(texts, perplexity.read_costs(spark, path)).withColumn("value", F.round("value", 4))


def first_sentence(prompt, preset):
    """A reader without a model: the first sentence of the context."""
    context = F.substring_index(prompt, "##CONTEXT: ", -1)
    return F.array_repeat(F.coalesce(F.get(tx.sentences(context), 0), F.lit("")), preset.num_return_sequences)


def _by_length(prompt, preset):
    said = F.when(F.length(prompt) % 2 == 0, "This one is POSITIVE.").otherwise("NEGATIVE, not Positive.")
    return F.array_repeat(said, preset.num_return_sequences)


@query(
    "reading_suite",
    f"WITH {PAIRS}, s AS (SELECT q_id, conv_id, prompt, {s_sentences('passage')} AS se FROM qa), "
    "r AS (SELECT q_id, prompt, coalesce(se[1], '') AS pred, CASE WHEN conv_id % 2 = 0 THEN se ELSE se[2:] END AS golds FROM s), "
    "x AS (SELECT q_id, pred, unnest(golds) AS gold, generate_subscripts(golds, 1) AS gi FROM r), "
    f"tk AS (SELECT q_id AS run_id, gi AS idx, {s_answer_tokens('pred')} AS p, {s_answer_tokens('gold')} AS g FROM x), "
    f"{_s_counts(1)}, f AS (SELECT run_id, idx, 2.0 * sum(least(a, b)) / sum(a + b) AS f1 FROM ct GROUP BY 1, 2), "
    "pe AS (SELECT tk.run_id AS q_id, max((p = g)::INT) AS em, max(coalesce(f1, 0)) AS f1 FROM tk LEFT JOIN f ON f.run_id = tk.run_id AND f.idx = tk.idx GROUP BY 1), "
    "av AS (SELECT 100 * avg(coalesce(em, 0)) AS em, 100 * avg(coalesce(f1, 0)) AS f1 FROM r LEFT JOIN pe USING (q_id)), "
    f"jd AS (SELECT q_id, {s_judge('ga', 'pred')} AS verdict FROM (SELECT q_id, pred, array_to_string(golds, ', ') AS ga FROM r)), "
    "m AS (SELECT 'squad_exact_match' AS metric, NULL::BIGINT AS idx, em AS x, NULL::VARCHAR AS text FROM av UNION ALL SELECT 'squad_f1', NULL, f1, NULL FROM av "
    "UNION ALL SELECT 'squad_oracle_acc', q_id, CASE verdict WHEN 'YES' THEN 1.0 WHEN 'PARTLY' THEN 0.5 ELSE 0.0 END, NULL FROM jd "
    "UNION ALL SELECT 'squad_oracle_acc_text', q_id, NULL, verdict FROM jd) "
    "SELECT 'reading' AS run_id, 'squad' AS suite, metric, idx, round(x, 4)::DOUBLE AS value, text FROM m",
)
def reading_suite(spark, sf):
    """Questions with their passages as context, read by the first-sentence reader; half of the rows do not accept it."""
    golds = tx.sentences(F.col("passage"))
    accepted = F.when(F.col("conv_id") % 2 == 0, golds).otherwise(F.slice(golds, F.lit(2), F.size(golds)))
    rows = t.qa_pairs(spark, sf).select(
        F.col("q_id").alias("idx"), F.col("prompt").alias("question"), F.col("passage").alias("context"), accepted.alias("answers")
    )
    return suites.reading_run(rows, g.Model(first_sentence)).withColumn("value", F.round("value", 4))


@query(
    "sentiment_suite",
    "SELECT 'sentiment' AS run_id, 'sst2' AS suite, 'glue_sst2_accuracy' AS metric, NULL::BIGINT AS idx, "
    f"round(avg(((length({s_fill(fixed.SENTIMENT_PROMPT, sentence='text')}) % 2 = 0)::INT = quality)::INT), 6) AS value, NULL::VARCHAR AS text "
    "FROM documents JOIN labels USING (doc_id)",
)
def sentiment_suite(spark, sf):
    """Labelled documents asked for their sentiment; the answer hangs on the prompt's length."""
    labels = t.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = t.table(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence")).join(labels, "doc_id")
    return suites.sentiment_run(rows, g.Model(_by_length)).withColumn("value", r6("value"))


@query("instruction_suite")
def instruction_suite(spark, sf):
    """The thousand sampled instructions, every second with an input, answered by the echo; BLEU, ROUGE, judged accuracy."""
    first = F.coalesce(F.get(tx.sentences(F.col("passage")), 0), F.lit(""))
    rows = t.qa_pairs(spark, sf).select(
        F.lit("instructions").alias("run_id"), F.col("q_id").alias("idx"), F.col("prompt").alias("instruction"),
        F.when(F.col("conv_id") % 2 == 0, first).otherwise("").alias("input"), F.col("passage").alias("reference"),
    )
    return suites.instruction_run(rows, g.BASELINE).withColumn("value", r6("value"))
