"""The registered queries of the training-data operators, and their check SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, centroids, decontaminate, extract, fim, langid, pieces, pii, simhash, tokenfiles, tokens, toxicity, warc,
)
from .common import fresh_folder, table, tokenizer_path

WORD_TOKENS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.main_text(table(spark, folder, "pages"))


def op2_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.sampled_digests(table(spark, folder, "documents"), tokenizer_path(PIECES))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts with an empty cache of its own, so that each run does the whole work."""
    cache = fresh_folder(spark, "token-counts")
    return tokens.token_counts(table(spark, folder, "documents"), cache, tokenizer_path(WORD_TOKENS))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("hits")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_folder(spark, "token-files")
    manifest = tokenfiles.write_token_files(table(spark, folder, "documents"), out, tokenizer_path(WORD_TOKENS))
    return tokenfiles.read_token_files(spark, out, manifest)


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.report(centroids.cluster(table(spark, folder, "embeddings")))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumn("offending", F.size("offending").cast("bigint"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text, op2_sampled_pieces, op3_personal_data, op4_simhash, op5_token_counts,
        op6_language, op7_warc, op8_nearest, op9_contamination, op10_token_files,
        op11_centroids, op12_toxicity, op13_fill_in_middle,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LETTERS}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _s_rounds() -> str:
    """The rounds of the centroid check, one set of tables after another."""
    nearest = (
        "SELECT row, n, d FROM (SELECT row, n, sum((x - c) * (x - c))::BIGINT AS d FROM v JOIN c{i} USING (j) GROUP BY 1, 2) "
        "QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, n) = 1"
    )
    # Integer division cuts towards zero; taking the remainder off first makes it a floor.
    mean = "(s - ((s % m) + m) % m) // m"
    parts = []
    for i in range(centroids.ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(i=i)})")
        parts.append(
            f"c{i + 1} AS MATERIALIZED (SELECT n, j, coalesce({mean}, c)::BIGINT AS c FROM c{i} LEFT JOIN "
            f"(SELECT n, j, sum(x)::BIGINT AS s, count(*) AS m FROM a{i} JOIN v USING (row) GROUP BY 1, 2) USING (n, j))"
        )
    parts.append(f"last AS MATERIALIZED ({nearest.format(i=centroids.ROUNDS)})")
    return ", ".join(parts)


CHECKS = {
    # Base32 of the SHA-1: five hex digits are four characters.
    "op7_warc": f"""
WITH h AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
  ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest FROM h),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM w""",
    "op9_contamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, i, n FROM dg JOIN g USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_centroids": f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMS}),
v AS MATERIALIZED (SELECT row, unnest(range(1, {centroids.DIMS + 1})) AS j, floor({centroids.SCALE} * unnest(e))::BIGINT AS x FROM k),
f AS (SELECT row, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS n FROM k QUALIFY n < {centroids.CENTROIDS}),
c0 AS MATERIALIZED (SELECT n, j, x AS c FROM f JOIN v USING (row)), {_s_rounds()},
g AS (SELECT n, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{centroids.ROUNDS} GROUP BY 1)
SELECT vec_id, n::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM k JOIN last USING (row) JOIN g USING (n)""",
    "op13_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3,
  ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fim.CUT_PERCENT} THEN 'plain'
    WHEN h4 % 100 < {fim.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
