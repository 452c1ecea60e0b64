"""Queries over text columns, positions and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import generate as g
from ..operators import judge, order, prompts, tokens
from ..sources import store
from ..sources import tables as t
from .registry import (
    PAIRS, QUESTIONS, lit, query, r6, s_fill, s_sentences, s_strip, s_tokens, s_words,
)

SPECIAL_TOKENS = ["<s>", "</s>", "<|end|>", "<|assistant|>", "<unk>"]


@query("scan_qa_pairs", f"WITH {PAIRS} SELECT * FROM qa")
def scan_qa_pairs(spark, sf):
    return t.qa_pairs(spark, sf)


@query(
    "slice_union",
    f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (ORDER BY q_id) - 1 AS pos, count(*) OVER () AS n FROM qa) "
    "SELECT q_id, prompt, floor(pos / ceil(n / 10.0))::INT AS slice FROM n",
)
def slice_union(spark, sf):
    return order.with_slices(t.qa_pairs(spark, sf).select("q_id", "prompt"), "q_id")


@query(
    "assign_batches",
    "SELECT o_orderkey, (ntile(greatest(1, ceil((SELECT count(*) FROM orders) / 256.0)::BIGINT)) "
    "OVER (ORDER BY o_orderkey) - 1)::INT AS batch_id FROM orders",
)
def assign_batches(spark, sf):
    return order.with_batches(t.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 256)


@query(
    "seeded_sample",
    "SELECT doc_id, text FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 1000",
)
def seeded_sample(spark, sf):
    return order.seeded_sample(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(
    "sorted_predictions",
    f"WITH {PAIRS} SELECT q_id, {s_strip('prompt')} AS prompt, {s_strip('passage')} AS passage FROM qa "
    "ORDER BY prompt DESC",
)
def sorted_predictions(spark, sf):
    rows = t.qa_pairs(spark, sf).select("q_id", tx.clean(F.col("prompt")).alias("prompt"), tx.clean(F.col("passage")).alias("passage"))
    return rows.orderBy(F.col("prompt").desc())


@query(
    "vocab_terms",
    "SELECT DISTINCT replace(p_name, ' ', '_') || ' ### ' || lower(p_type) AS term FROM part",
)
def vocab_terms(spark, sf):
    return t.vocab_terms(spark, sf)


def _s_template(row) -> str:
    _, prefix, suffix, _, _, tidied = row
    body = "prompt"
    if tidied:
        body = f"replace(replace({s_strip('prompt')}, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10))"
    return f"{lit(prefix)} || {body} || {lit(suffix)}"


_RENDERED = " UNION ALL ".join(
    f"SELECT q_id, {lit(row[0])} AS model, {_s_template(row)} AS rendered, passage FROM qa" for row in fixed.TEMPLATES
)


@query("render_prompts", f"WITH {PAIRS}, r AS ({_RENDERED}) SELECT q_id, model, rendered FROM r")
def render_prompts(spark, sf):
    return prompts.all_templates(t.qa_pairs(spark, sf).select("q_id", "prompt"), "prompt").select("q_id", "model", "rendered")


def _s_extract(row) -> str:
    _, _, _, marker, stripped, _ = row
    out = f"string_split(raw, {lit(marker)})[-1]" if marker else "raw"
    return f"WHEN model = {lit(row[0])} THEN {s_strip(out) if stripped else out}"


@query(
    "extract_response",
    f"WITH {PAIRS}, r AS ({_RENDERED}), w AS (SELECT q_id, model, rendered || ' ' || passage || chr(10) AS raw FROM r) "
    f"SELECT q_id, model, CASE {' '.join(_s_extract(row) for row in fixed.TEMPLATES)} END AS response FROM w",
)
def extract_response(spark, sf):
    rendered = prompts.all_templates(t.qa_pairs(spark, sf).select("q_id", "prompt", "passage"), "prompt")
    raw = rendered.withColumn("raw", F.concat("rendered", F.lit(" "), "passage", F.lit("\n")))
    return raw.select("q_id", "model", prompts.extract_by_model(raw, "raw").alias("response"))


_RAW = "'<s>' || text || '<</s>s><|end|>' || '<|assis<unk>tant|>' || text || '</s>'"
_CLEAN = _RAW
for _token in SPECIAL_TOKENS:
    _CLEAN = f"replace({_CLEAN}, {lit(_token)}, '')"


@query("strip_special_tokens", f"SELECT doc_id, {_CLEAN} AS text FROM documents")
def strip_special_tokens(spark, sf):
    raw = F.concat(F.lit("<s>"), "text", F.lit("<</s>s><|end|>"), F.lit("<|assis<unk>tant|>"), "text", F.lit("</s>"))
    return t.table(spark, sf, "documents").select("doc_id", tx.remove_tokens(raw, SPECIAL_TOKENS).alias("text"))


@query(
    "open_prompts",
    f"WITH {QUESTIONS} SELECT q_id, {lit(fixed.TOPIC_PROMPT)} AS topic_prompt, "
    f"{s_fill(fixed.OPEN_QUESTION_PROMPT, topics='prompt')} AS question_prompt, "
    f"{s_fill(fixed.TRENDING_QUESTION_PROMPT, topics='prompt')} AS trending_prompt, "
    f"{s_fill(fixed.PASSAGE_PROMPT, question='prompt')} AS passage_prompt FROM q",
)
def open_prompts(spark, sf):
    p = F.col("prompt")
    return t.questions(spark, sf).select(
        "q_id",
        prompts.topic_prompt().alias("topic_prompt"),
        prompts.open_question(p).alias("question_prompt"),
        prompts.trending_question(p).alias("trending_prompt"),
        prompts.passage(p).alias("passage_prompt"),
    )


@query(
    "induced_prompts",
    f"WITH {QUESTIONS}, w AS (SELECT unnest({fixed.QUESTION_WORDS}) AS question_word) SELECT q_id AS topic_id, question_word, "
    f"{s_fill(fixed.INDUCED_QUESTION_PROMPT, topics='prompt', word='question_word')} AS question_prompt FROM q, w",
)
def induced_prompts(spark, sf):
    rows = prompts.with_question_words(t.questions(spark, sf).select(F.col("q_id").alias("topic_id"), "prompt"))
    return rows.select(
        "topic_id", "question_word", prompts.induced_question(F.col("prompt"), F.col("question_word")).alias("question_prompt")
    )


@query(
    "clean_columns",
    f"SELECT d.doc_id, {s_strip('text')} AS text, coalesce(quality::VARCHAR, '-') AS quality_text, "
    "n_chars::DOUBLE AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def clean_columns(spark, sf):
    docs = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select(
        "doc_id",
        tx.clean(F.col("text")).alias("text"),
        tx.clean(F.col("quality")).alias("quality_text"),
        F.col("n_chars").cast("double").alias("score"),
    )


@query("run_key", "SELECT page_id, translate(url, '/.', '__') || '_OracleSelected' AS run_key FROM pages")
def run_key(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", store.run_key(F.col("url"), "oracle").alias("run_key"))


S_CUT = f"array_to_string(string_split(b, ' ')[:{fixed.EVAL_WORDS}], ' ')"


@query(
    "truncate_words",
    f"WITH s AS (SELECT doc_id, {s_strip('text')} AS b FROM documents) SELECT doc_id, {S_CUT} AS text, "
    f"CASE WHEN len(string_split(b, ' ')) > {fixed.EVAL_WORDS} THEN {S_CUT} ELSE substr(b, 1, length(b) - 1) END AS compat_text "
    "FROM s WHERE length(b) > 1",
)
def truncate_words(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", tx.strip(F.col("text")).alias("text")).filter(F.length("text") > 1)
    return docs.select(
        "doc_id",
        tx.cut_words(F.col("text"), fixed.EVAL_WORDS).alias("text"),
        tx.cut_words(F.col("text"), fixed.EVAL_WORDS, compat=True).alias("compat_text"),
    )


@query(
    "text_lengths",
    f"SELECT doc_id, length({s_strip('text')})::BIGINT AS chars, len({s_words('text')})::BIGINT AS words FROM documents",
)
def text_lengths(spark, sf):
    text = F.col("text")
    return t.table(spark, sf, "documents").select(
        "doc_id", F.length(tx.strip(text)).cast("bigint").alias("chars"), F.size(tx.words(text)).cast("bigint").alias("words")
    )


@query(
    "min_token_filter",
    f"WITH n AS (SELECT doc_id, len({s_words('text')})::INT AS n_tokens FROM documents) SELECT doc_id, n_tokens, "
    "CASE WHEN n_tokens < 2 THEN 'fewer than 2 token(s)' END AS reason FROM n",
)
def min_token_filter(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "text")
    return tokens.check_length(docs, "text", start_token=False).select("doc_id", "n_tokens", "reason")


@query(
    "instruction_prompts",
    f"WITH {QUESTIONS}, s AS (SELECT conv_id, text AS sys FROM conversations WHERE role = 'system' AND turn = 0) "
    "SELECT q_id, CASE WHEN coalesce(sys, '') = '' THEN prompt ELSE "
    f"{s_fill(fixed.INSTRUCTION_PROMPT, instruction='prompt', input='sys')} END AS formatted_prompt "
    "FROM q LEFT JOIN s USING (conv_id)",
)
def instruction_prompts(spark, sf):
    system = (
        t.table(spark, sf, "conversations")
        .filter((F.col("role") == "system") & (F.col("turn") == 0))
        .select("conv_id", F.col("text").alias("sys"))
    )
    rows = t.questions(spark, sf).join(system, "conv_id", "left")
    return rows.select("q_id", prompts.instruction(F.col("prompt"), F.coalesce("sys", F.lit(""))).alias("formatted_prompt"))


@query(
    "eval_prompts",
    f"WITH {PAIRS} SELECT q_id, {s_fill(fixed.READING_PROMPT, question='prompt', context='passage')} AS reading_prompt, "
    f"{s_fill(fixed.SENTIMENT_PROMPT, sentence='passage')} AS sentiment_prompt FROM qa",
)
def eval_prompts(spark, sf):
    return t.qa_pairs(spark, sf).select(
        "q_id",
        prompts.reading(F.col("prompt"), F.col("passage")).alias("reading_prompt"),
        prompts.sentiment(F.col("passage")).alias("sentiment_prompt"),
    )


@query(
    "judge_messages",
    f"WITH {PAIRS} SELECT q_id, "
    f"{s_fill(fixed.ACCURACY_MESSAGE, prompt='prompt', gold='passage', answer='prompt')} AS accuracy_message, "
    f"{s_fill(fixed.RELEVANCE_MESSAGE, prompt='prompt', context='passage')} AS relevance_message FROM qa",
)
def judge_messages(spark, sf):
    p, a = F.col("prompt"), F.col("passage")
    return t.qa_pairs(spark, sf).select(
        "q_id",
        judge.accuracy_message(p, a, p).alias("accuracy_message"),
        judge.relevance_message(p, a).alias("relevance_message"),
    )


S_VERDICT_TEXT = (
    "CASE WHEN quality = 1 AND toxic = 0 THEN ' Yes, it does.' WHEN quality = 1 AND toxic = 1 THEN 'PARTLY.' || chr(10) "
    "WHEN quality = 0 AND toxic = 0 THEN 'Not sure' ELSE 'n/a' END"
)
S_VERDICT = (
    "CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' WHEN quality = 1 AND toxic = 1 THEN 'partly' "
    "WHEN quality = 0 AND toxic = 0 THEN 'no' ELSE 'other' END"
)
S_VERDICT_SCORE = (
    "CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 AND toxic = 1 THEN 0.5 "
    "WHEN quality = 0 AND toxic = 0 THEN 0.0 ELSE -99.0 END::DOUBLE"
)


@query(
    "verdict_scores",
    f"SELECT doc_id, {S_VERDICT_TEXT} AS verdict_text, {S_VERDICT_SCORE} AS similarity, "
    "NOT (quality = 0 AND toxic = 1) AS is_valid_verdict FROM labels",
)
def verdict_scores(spark, sf):
    rows = t.verdicts(spark, sf).withColumn("similarity", tx.verdict_score(F.col("verdict_text")))
    return rows.select("doc_id", "verdict_text", "similarity", (F.col("similarity") != fixed.UNKNOWN_VERDICT).alias("is_valid_verdict"))


@query("verdict_histogram", f"SELECT {S_VERDICT} AS verdict, count(*) AS n FROM labels GROUP BY 1")
def verdict_histogram(spark, sf):
    return t.verdicts(spark, sf).groupBy(tx.verdict_class(F.col("verdict_text")).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "passage_sentences",
    f"WITH {PAIRS} SELECT q_id, unnest({s_sentences('passage')}) AS sentence, "
    f"(generate_subscripts({s_sentences('passage')}, 1) - 1)::INT AS sent_idx FROM qa",
)
def passage_sentences(spark, sf):
    return t.qa_pairs(spark, sf).select("q_id", F.posexplode(tx.sentences(F.col("passage"))).alias("sent_idx", "sentence"))


def s_page_text(x: str) -> str:
    for tag in ("script", "style", "head", "nav", "footer", "aside", "form", "noscript"):
        x = f"regexp_replace({x}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    blocks = "p|div|br|h[1-6]|li|ul|ol|tr|table|article|section"
    x = f"regexp_replace({x}, '(?i)</?({blocks})(\\s[^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    x = f"regexp_replace({x}, '[ \\t\\r\\f]+', ' ', 'g')"
    return s_strip(f"regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g')")


@query(
    "page_text",
    f"WITH p AS (SELECT page_id, url, {s_page_text('html')} AS full_text FROM pages) SELECT * FROM p WHERE full_text <> ''",
)
def page_text(spark, sf):
    return t.pages(spark, sf)


def s_token_ids(x: str) -> str:
    return f"list_transform({s_words(x)}, lambda w: ('0x' || substr(md5(w), 1, 15))::BIGINT + 1)"


@query(
    "fix_length_tokens",
    f"WITH i AS (SELECT doc_id, {s_token_ids('text')} AS ids FROM documents) SELECT doc_id, len(ids)::INT AS n_tokens, "
    "array_to_string(list_transform(generate_series(1, 256), lambda j: coalesce(ids[j], 0)), ' ') AS ids, "
    "least(len(ids), 256)::INT AS mask_sum FROM i",
)
def fix_length_tokens(spark, sf):
    rows = tokens.fixed_rows(t.spread(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "text")
    return rows.select(
        "doc_id",
        "n_tokens",
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
        F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
    )


@query(
    "pad_to_batch_max",
    f"WITH {PAIRS}, i AS (SELECT q_id, {s_token_ids('prompt')} AS ids, "
    "(ntile(greatest(1, ceil((SELECT count(*) FROM qa) / 16.0)::BIGINT)) OVER (ORDER BY q_id) - 1)::INT AS batch_id FROM qa), "
    "m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM i) "
    "SELECT q_id, batch_id, longest::INT AS longest, array_to_string(list_transform(generate_series(1, longest), "
    "lambda j: coalesce(ids[j], 0)), ' ') AS padded FROM m",
)
def pad_to_batch_max(spark, sf):
    rows = t.qa_pairs(spark, sf).select("q_id", tokens.token_ids(F.col("prompt")).alias("ids"))
    padded = tokens.pad_to_batch(order.with_batches(rows, "q_id", 16), "ids", "batch_id")
    return padded.select("q_id", "batch_id", "longest", F.array_join(F.col("padded").cast("array<string>"), " ").alias("padded"))


@query(
    "baseline_generate",
    f"WITH {QUESTIONS} SELECT q_id, (unnest(generate_series(1, 10)) - 1)::INT AS sample_idx, prompt || '...' AS text FROM q",
)
def baseline_generate(spark, sf):
    rows = g.with_samples(t.questions(spark, sf), "samples", g.BASELINE, F.col("prompt"))
    return rows.select("q_id", F.posexplode("samples").alias("sample_idx", "text"))


@query(
    "nest_samples",
    "SELECT conv_id, (turn // 10)::BIGINT AS chunk, count(*) AS n_samples, "
    "string_agg(text, ' | ' ORDER BY turn) AS samples FROM conversations WHERE role = 'assistant' GROUP BY 1, 2",
)
def nest_samples(spark, sf):
    # lists of at most ten texts, as many per conversation as it needs
    rows = t.answers(spark, sf).withColumn("chunk", F.floor(F.col("turn") / fixed.SAMPLES_PER_QUESTION).cast("bigint"))
    nested = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return nested.select(
        "conv_id", "chunk", F.size("s").cast("bigint").alias("n_samples"),
        F.array_join(F.transform("s", lambda x: x["text"]), " | ").alias("samples"),
    )


@query(
    "trending_topics",
    "WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type || ':' || json_extract_string(props, '$.k') AS title FROM events), "
    "c AS (SELECT h, title, count(*) AS n FROM e GROUP BY 1, 2) SELECT strftime(h, '%Y-%m-%d %H') AS hour, title, n, "
    "row_number() OVER (PARTITION BY h ORDER BY n DESC, title) AS rank FROM c "
    "QUALIFY rank <= 100",
)
def trending_topics(spark, sf):
    from ..streaming import trends

    counts = trends.hourly_counts(t.topic_events(t.table(spark, sf, "events")))
    return trends.top_topics(counts).select(
        F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "title", "n", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "judge_lexical",
    f"WITH {PAIRS}, k AS (SELECT q_id, list_distinct({s_tokens('prompt')}) AS p, list_distinct({s_tokens('passage')}) AS a FROM qa), "
    "f AS (SELECT q_id, coalesce(2.0 * len(list_intersect(p, a)) / nullif(len(p) + len(a), 0), 0)::DOUBLE AS f1, "
    "coalesce(len(list_intersect(p, a))::DOUBLE / nullif(len(p), 0), 0) AS share FROM k) SELECT q_id, round(f1, 6) AS f1, "
    "CASE WHEN f1 >= 0.8 THEN 'YES' WHEN f1 >= 0.3 THEN 'PARTLY' ELSE 'NO' END AS agreement, "
    "CASE WHEN share >= 0.5 THEN 'YES' WHEN share >= 0.2 THEN 'PARTLY' ELSE 'NO' END AS relevance FROM f",
)
def judge_lexical(spark, sf):
    p, a = F.col("prompt"), F.col("passage")
    return t.qa_pairs(spark, sf).select(
        "q_id",
        r6(judge.overlap_f1(a, p)).alias("f1"),
        judge.lexical_judge(p, a, p).alias("agreement"),
        judge.lexical_relevance(p, a).alias("relevance"),
    )
