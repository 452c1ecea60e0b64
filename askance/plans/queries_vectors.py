"""Queries over vectors: embeddings, neighbours, topics, routing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import vectors as v
from ..operators import cells, neighbours, report, routing
from ..session import cut_lineage, shared_folder
from ..sources import increment, store
from ..sources import tables as t
from . import runs, sweep, views
from .queries_scoring import _ASKED_INDUCED, _ASKED_OPEN, _HOURS, _R6_MEASURES, _ROUNDED, MEASURES, _polled, rounded, s_report
from .registry import QUESTIONS, SCORES, query, r6, s_fill, s_sentences, s_words

DIMS = 64
_L1 = "list_transform(embedding::DOUBLE[], lambda x: x / greatest(list_sum(list_transform(embedding::DOUBLE[], lambda y: abs(y))), 1e-12))"
_LONG = "generate_subscripts({x}, 1)::INT - 1 AS j, unnest({x}) AS x"


@query("l1_normalize", f"WITH n AS (SELECT vec_id, {_L1} AS e FROM embeddings), l AS (SELECT vec_id, {_LONG.format(x='e')} FROM n) "
       "SELECT vec_id, j, round(x, 6) AS x FROM l")
def l1_normalize(spark, sf):
    rows = t.table(spark, sf, "embeddings").select("vec_id", v.l1_normalize(F.col("embedding")).alias("e"))
    return rows.select("vec_id", F.posexplode("e").alias("j", "x")).withColumn("x", r6("x"))


_MEAN = (
    f"l AS (SELECT vec_id, label, {_LONG.format(x='embedding::DOUBLE[]')} FROM embeddings), "
    "m AS (SELECT label, j, avg(x) AS m FROM l GROUP BY 1, 2)"
)


@query("vector_mean", f"WITH {_MEAN} SELECT label, j, round(m, 6) AS m FROM m")
def vector_mean(spark, sf):
    pooled = routing.mean_pool(t.table(spark, sf, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("features").alias("j", "m")).withColumn("m", r6("m"))


@query(
    "cosine_pairs",
    f"WITH {_MEAN}, s AS (SELECT l.vec_id, sum(l.x * m.m) AS d, sqrt(sum(l.x * l.x)) * sqrt(sum(m.m * m.m)) AS n "
    "FROM l JOIN m USING (label, j) GROUP BY 1) SELECT vec_id, round(d / nullif(n, 0), 6) AS cosine FROM s",
)
def cosine_pairs(spark, sf):
    rows = t.table(spark, sf, "embeddings")
    centre = routing.mean_pool(rows, ["label"], "embedding")
    return rows.join(centre, "label").select("vec_id", r6(v.cosine(F.col("embedding"), F.col("features"))).alias("cosine"))


@query(
    "hash_embed",
    f"WITH {QUESTIONS}, w AS (SELECT q_id, unnest({s_words('lower(prompt)')}) AS w FROM q), "
    f"c AS (SELECT q_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % {DIMS})::INT AS j, count(*) AS n FROM w GROUP BY 1, 2) "
    "SELECT q_id, j, round(n / sqrt(sum(n * n) OVER (PARTITION BY q_id)), 6) AS x FROM c",
)
def hash_embed(spark, sf):
    rows = t.questions(spark, sf).select("q_id", v.hash_embedding(F.col("prompt"), DIMS).alias("e"))
    return rows.select("q_id", F.posexplode("e").alias("j", "x")).filter(F.col("x") != 0).withColumn("x", r6("x"))


def _points(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("q_id"), v.l1_normalize(F.col("embedding")).alias("vector"))


def _vocab(spark, sf):
    return t.vocabulary(spark, sf).withColumn("embedding", v.l1_normalize(F.col("embedding")))


_KNN = (
    f"n AS (SELECT vec_id, {_L1} AS e FROM embeddings), d AS (SELECT a.vec_id AS q_id, b.vec_id AS term_id, "
    "list_distance(a.e, b.e) AS distance FROM n a, n b), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, term_id)::INT AS rank FROM d QUALIFY rank <= 10)"
)


@query("knn_join", f"WITH {_KNN} SELECT q_id, term_id, round(distance, 9) AS distance, rank FROM k")
def knn_join(spark, sf):
    points = _points(spark, sf)
    vocab = points.select(F.col("q_id").alias("term_id"), F.col("vector").alias("embedding"))
    return neighbours.nearest(points, vocab).withColumn("distance", F.round("distance", 9))


@query("knn_cells", f"WITH {_KNN} SELECT q_id, term_id, round(distance, 9) AS distance, rank FROM k WHERE q_id % 50 = 0")
def knn_cells(spark, sf):
    """The stated query set, every fiftieth vector, against all vectors through cells around pivots."""
    points = _points(spark, sf)
    vocab = points.select(F.col("q_id").alias("term_id"), F.col("vector").alias("embedding"))
    found = cells.nearest(points.filter(F.col("q_id") % 50 == 0), vocab)
    return found.rows.withColumn("distance", F.round("distance", 9))


_TOPICS = (
    f"{_KNN}, voc AS (SELECT vec_id AS term_id, coalesce(replace(p_name, ' ', '_') || ' ### ' || lower(p_type), "
    "'term_' || vec_id || ' ### label ' || label) AS term FROM embeddings LEFT JOIN part ON p_partkey = vec_id), "
    f"dr AS (SELECT q_id, term_id, md5(q_id || ':' || term_id || ':{fixed.EVAL_SEED}') AS draw FROM k "
    "QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY draw) <= 3), "
    "tp AS (SELECT q_id, string_agg(replace(string_split(term, ' ### ')[1], '_', ' '), ', ' ORDER BY draw) AS topics "
    "FROM dr JOIN voc USING (term_id) GROUP BY 1)"
)


@query("oracle_topics", f"WITH {_TOPICS} SELECT * FROM tp")
def oracle_topics(spark, sf):
    return runs.oracle_topics(_points(spark, sf), _vocab(spark, sf))


def _oracle_run(spark, sf):
    topics = runs.oracle_topics(_points(spark, sf), _vocab(spark, sf))
    iterations = t.table(spark, sf, "embeddings").select(F.col("label").alias("run_id"), F.col("vec_id").alias("q_id"))
    return runs.oracle_run(iterations, topics)


@query("baseline_oracle_run")
def baseline_oracle_run(spark, sf):
    """The report of the oracle-selected runs, clusters included; ``oracle_measures`` checks the other columns."""
    return rounded(runs.full_report(cut_lineage(_oracle_run(spark, sf).select("run_id", "prompt", "hallucinated"))), _ROUNDED)


@query(
    "oracle_measures",
    f"WITH {_TOPICS}, src AS (SELECT label AS run, "
    f"{s_fill(fixed.PASSAGE_PROMPT, question=s_fill(fixed.OPEN_QUESTION_PROMPT, topics='topics'))} || '...' AS prompt, false AS hallucinated FROM tp "
    f"JOIN embeddings ON vec_id = q_id), rep AS ({s_report('run', 'src')}) {_R6_MEASURES}",
)
def oracle_measures(spark, sf):
    return rounded(report.run_measures(_oracle_run(spark, sf)), MEASURES)


def _s_uniform(tag: str) -> str:
    return f"(('0x' || substr(md5(vec_id || ':' || j || ':42{tag}'), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710657.0::DOUBLE"


@query(
    "random_points",
    f"WITH g AS (SELECT vec_id, unnest(generate_series(0, {DIMS - 1}))::INT AS j FROM embeddings), "
    f"z AS (SELECT vec_id, j, sqrt(-2 * ln({_s_uniform('a')})) * cos(2 * pi() * {_s_uniform('b')}) AS z FROM g) "
    "SELECT vec_id, j, round(z / sum(abs(z)) OVER (PARTITION BY vec_id), 6) AS x FROM z",
)
def random_points(spark, sf):
    ids = t.table(spark, sf, "embeddings").select("vec_id")
    points = neighbours.random_points(ids, DIMS, fixed.EVAL_SEED, key="vec_id")
    return points.select("vec_id", F.posexplode("vector").alias("j", "x")).withColumn("x", r6("x"))


@query("route_rows")
def route_rows(spark, sf):
    rows = t.table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 5, 0).otherwise(1).alias("label"))
    return routing.route(rows, "vec_id", "embedding", routing.fit_router(rows, "embedding"), ["base_model", "adapter"])


# ---- stages that grow, metric sinks, configurations as rows -----------------------------------

@query(
    "pooled_features",
    f"WITH {QUESTIONS}, s AS (SELECT q_id, unnest(se) AS sentence, generate_subscripts(se, 1) AS i, len(se) AS n_parts FROM "
    f"(SELECT q_id, {s_sentences('prompt')} AS se FROM q)), w AS (SELECT q_id, i, unnest({s_words('lower(sentence)')}) AS w FROM s), "
    f"c AS (SELECT q_id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIMS} AS j, count(*) AS n FROM w GROUP BY 1, 2, 3), "
    "e AS (SELECT q_id, i, j, n / sqrt(sum(n * n) OVER (PARTITION BY q_id, i)) AS x FROM c), "
    "p AS (SELECT q_id, any_value(n_parts)::BIGINT AS n_parts FROM s GROUP BY 1), "
    "m AS (SELECT q_id, j, sum(x) / any_value(n_parts) AS x FROM e JOIN p USING (q_id) GROUP BY 1, 2) "
    "SELECT q_id, any_value(n_parts) AS n_parts, round(sqrt(sum(x * x)), 6) AS length, round(sum(x * (j + 1)), 4) AS weighed, "
    "q_id // 4294967296 % 2 = 0 AS reused FROM m JOIN p USING (q_id) GROUP BY q_id",
)
def pooled_features(spark, sf):
    """Router features of every question from a stage table: one run over half of the conversations, one over all,
    which computes the other half only."""
    stage = increment.Stage(f"{shared_folder(spark).rstrip('/')}/features-{uuid4().hex}", version=f"hash{DIMS}")
    asked = t.questions(spark, sf).select("q_id", "prompt")

    def make(rows):
        made = routing.text_features(rows, "prompt", lambda s: v.hash_embedding(s, DIMS), DIMS)
        return made.select(increment.KEY, "n_parts", "features")

    stage.extend(asked.filter(F.shiftright("q_id", 32) % 2 == 0), ["q_id"], make)
    early = stage.stored(spark, "keys", f"{increment.KEY} string").withColumn("old", F.lit(True))
    rows = stage.extend(asked, ["q_id"], make).join(early, increment.KEY, "left")
    weighed = F.aggregate(
        F.zip_with("features", F.sequence(F.lit(1), F.lit(DIMS)), lambda x, j: x * j), F.lit(0.0), lambda a, x: a + x
    )
    return rows.select(
        "q_id", "n_parts", r6(v.l2_norm(F.col("features"))).alias("length"), F.round(weighed, 4).alias("weighed"),
        F.coalesce("old", F.lit(False)).alias("reused"),
    )


@query(
    "metrics_replayed",
    f"WITH {QUESTIONS}, m AS (SELECT conv_id::VARCHAR AS run_id, count(*) AS n_questions, avg(length(prompt)) AS mean_length FROM q GROUP BY 1) "
    "SELECT run_id, 'run' AS suite, k AS metric, NULL::BIGINT AS idx, round(x, 6)::DOUBLE AS value, NULL::VARCHAR AS text, b AS batch FROM "
    "(SELECT run_id, 'learned_n_questions' AS k, n_questions::DOUBLE AS x FROM m UNION ALL SELECT run_id, 'learned_mean_length', mean_length FROM m), "
    "(VALUES ('0'), ('1')) AS v(b)",
)
def metrics_replayed(spark, sf):
    """Metric rows of two batches, the first written once more: the table holds each once."""
    path = f"{shared_folder(spark).rstrip('/')}/metrics-{uuid4().hex}"
    runs_of = t.questions(spark, sf).groupBy(F.col("conv_id").alias("run_id")).agg(
        F.count("*").alias("n_questions"), F.avg(F.length("prompt")).alias("mean_length")
    )
    rows = cut_lineage(store.metric_rows(runs_of, "run", "learned_", ["n_questions", "mean_length"]).withColumn("value", r6("value")))
    for batch in ("0", "1", "0"):
        increment.put_metrics(rows, path, batch, by=("suite", "batch"))
    return increment.read_metrics(spark, path)


CONFIGS = [(f"{model}|{method}|{heat}", model, method, heat) for model in ("baseline", "other") for method in sweep.METHODS for heat in (0.5, 1.0)]
_S_CONFIGS = "cf AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{m}', '{k}', {h}::DOUBLE)" for r, m, k, h in CONFIGS) + ") AS v(run, model, method, temperature))"
_S_POLLED = _HOURS.replace("src AS", "ext AS").replace(", k AS", ", polled AS").replace("FROM k)", "FROM polled)")
_ORACLE_ASKED = s_fill(fixed.PASSAGE_PROMPT, question=s_fill(fixed.OPEN_QUESTION_PROMPT, topics="topics"))


@query(
    "config_sweep",
    f"WITH {QUESTIONS}, w AS (SELECT unnest({fixed.QUESTION_WORDS}) AS word), {_S_CONFIGS}, {_TOPICS}, {_S_POLLED}, "
    f"tp4 AS (SELECT 'open' AS method, {_ASKED_OPEN} AS prompt FROM q UNION ALL SELECT 'induced', {_ASKED_INDUCED} FROM q, w "
    f"UNION ALL SELECT 'oracle', {_ORACLE_ASKED} || '...' FROM tp UNION ALL SELECT 'external', prompt FROM ext), "
    f"src AS (SELECT run, prompt, false AS hallucinated FROM tp4 JOIN cf USING (method)), rep AS ({s_report('run', 'src')}), ms AS ({_R6_MEASURES}) "
    "SELECT run_id, model, method, temperature, n_questions, n_hallucinated, n_distinct, knowledge_limit_awareness_score, brevity_coefficient "
    "FROM ms JOIN cf ON run = run_id",
)
def config_sweep(spark, sf):
    """Sixteen configurations of all four methods, rows of a table, through one plan."""
    configs = spark.createDataFrame(CONFIGS, "run_id string, model string, method string, temperature double")
    points = _points(spark, sf)
    vocab = _vocab(spark, sf)
    near = cells.nearest(points, vocab).rows
    topics = sweep.method_topics(
        t.questions(spark, sf).select("q_id"), neighbours.pick_topics(near, vocab, fixed.EVAL_SEED), _polled(spark, sf)
    )
    measured = report.run_measures(sweep.scored_runs(configs, topics))
    return rounded(configs.join(measured, "run_id"), MEASURES)


@query(
    "rollup_report",
    f"WITH {SCORES}, s AS (SELECT 'm' || conv_id % 3 AS model, ['open', 'induced', 'oracle', 'external'][turn % 4 + 1] AS method, conv_id AS run_id, "
    "count(*) AS n, count_if(hallucinated) AS h, sum(abs(length(prompt) - 100)) AS g FROM sc GROUP BY 1, 2, 3), "
    "r AS (SELECT model, method, (2 - bit_count(grouping_id(model, method)))::INT AS level, count(*) AS n_runs, sum(n)::BIGINT AS n_questions, "
    "sum(h)::BIGINT AS n_hallucinated, sum(h)::DOUBLE / sum(n) AS a, sum(g)::DOUBLE / sum(n) AS gap FROM s GROUP BY ROLLUP (model, method)) "
    "SELECT model, method, level, n_runs, n_questions, n_hallucinated, round(a, 6) AS knowledge_limit_awareness_score, "
    "round(CASE WHEN gap >= 100 THEN 0.0 WHEN gap <= 50 THEN 1.0 ELSE 1.5 - gap / 100 END, 6)::DOUBLE AS brevity_coefficient FROM r",
)
def rollup_report(spark, sf):
    """Scores by model and method with subtotals, added up from one stored row of sums per run."""
    methods = F.array(*[F.lit(m) for m in sweep.METHODS])
    scored = views.scored(spark, sf).select(
        F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.get(methods, (F.col("turn") % 4).cast("int")).alias("method"),
        F.col("conv_id").alias("run_id"), "prompt", "hallucinated",
    )
    sums = cut_lineage(report.run_sums(scored, "model", "method"))
    return rounded(report.rollup_report(sums, "model", "method"), MEASURES)


@query("router_accuracy")
def router_accuracy(spark, sf):
    """Accuracy of a router on the rows it was fitted on and on the fifth held out, after storing and reading it."""
    rows = t.table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 5, 0).otherwise(1).alias("label"))
    model = routing.fit_router(rows.filter(~routing.held_out(F.col("vec_id"), fixed.EVAL_SEED)), "embedding")
    path = f"{shared_folder(spark).rstrip('/')}/router-{uuid4().hex}"
    routing.save_router(model, path)
    measured = routing.accuracy_rows(rows, "embedding", routing.load_router(path), fixed.EVAL_SEED, "vec_id")
    return store.metric_rows(measured, "router", "router_", ["n", "accuracy"]).withColumn("value", r6("value"))
