"""Row shapes of the stored tables, as DDL."""

RUN_CONFIG = "run_id string, model string, method string, temperature double, n int, batch_size int, seed int"
SCORED = (
    "run_id string, q_id bigint, topics string, prompt string, passage string, "
    "passage_sentences array<string>, samples array<string>, sentence_scores array<double>, "
    "average_score double, hallucinated boolean"
)
RUNS = (
    "run_id string, pretrained_model_name string, method string, curiosity_score double, "
    "knowledge_limit_awareness_score double, brevity_coefficient double, self_learning_capability_score double"
)
CURATED = (
    "prompt string, answer_text string, summary_text string, full_text string, answer_score double, source_url string"
)
PREFERENCE_PAIRS = "prompt string, chosen string, rejected string"
METRICS = "run_id string, suite string, metric string, idx bigint, value double, text string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
# input tables; declared so that opening one reads no footers
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": EVENTS,
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}
# evaluation sets
TEXT_EVAL = "text string"
INSTRUCTION_EVAL = "instruction string, input string, output string"
READING_EVAL = "id string, question string, context string, answers struct<text: array<string>>"
SENTIMENT_EVAL = "sentence string, label int"
