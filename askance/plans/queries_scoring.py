"""Queries over scored questions: sentence scores, splits, run measures and runs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import generate as g
from ..operators import report, routing, scoring, sketches
from ..session import cut_lineage, shared_folder
from ..sources import store
from ..sources import tables as t
from ..streaming import running
from . import runs, views
from .registry import NAN, PAIRS, QUESTIONS, SCORES, lit, query, r6, s_fill, s_sentences


@query("sentence_sample_pairs", f"WITH {SCORES} SELECT q_id, sent_idx::INT AS sent_idx, n_tri::BIGINT AS n_trigrams, n_samples, hits FROM ss")
def sentence_sample_pairs(spark, sf):
    """What the sentence-sample pairs add up to per sentence, without making the pairs."""
    return scoring.sentence_support(views.passages(spark, sf), views.samples(spark, sf), passage_in_pool=True)


@query("sentence_scores", f"WITH {SCORES} SELECT q_id, sent_idx::INT AS sent_idx, round(score, 6) AS score FROM ss")
def sentence_scores(spark, sf):
    return views.sentence_scores(spark, sf).withColumn("score", r6("score"))


@query("passage_scores", f"WITH {SCORES} SELECT q_id, n_sentences, round(average_score, 6) AS average_score FROM ps")
def passage_scores(spark, sf):
    rows = views.passages(spark, sf)
    return scoring.passage_scores(rows, views.sentence_scores(spark, sf)).withColumn("average_score", r6("average_score"))


@query(
    "assemble_scored",
    f"WITH {SCORES} SELECT q_id, prompt, passage, array_to_string({s_sentences('passage')}, ' | ') AS passage_sentences, "
    "n_sentences, round(average_score, 6) AS average_score, hallucinated FROM sc",
)
def assemble_scored(spark, sf):
    return views.scored(spark, sf).select(
        "q_id", "prompt", "passage",
        F.array_join(tx.sentences(F.col("passage")), " | ").alias("passage_sentences"),
        "n_sentences", r6("average_score").alias("average_score"), "hallucinated",
    )


@query(
    "split_hallucination",
    f"WITH {SCORES} SELECT q_id, round(average_score, 6) AS average_score, hallucinated, "
    "(CASE WHEN hallucinated THEN 0 ELSE 1 END)::INT AS part_ord FROM sc",
)
def split_hallucination(spark, sf):
    return views.scored(spark, sf).select("q_id", r6("average_score").alias("average_score"), "hallucinated", "part_ord")


@query("kla_score", f"WITH {SCORES} SELECT turn AS run_id, round(count_if(hallucinated)::DOUBLE / count(*), 6) AS awareness FROM sc GROUP BY 1")
def kla_score(spark, sf):
    return views.scored(spark, sf).groupBy(F.col("turn").alias("run_id")).agg(r6(report.awareness(F.col("hallucinated"))).alias("awareness"))


S_BREVITY = (
    "CASE WHEN avg(abs(length(prompt) - 100)) >= 100 THEN 0.0 WHEN avg(abs(length(prompt) - 100)) <= 50 THEN 1.0 "
    "ELSE 1.5 - avg(abs(length(prompt) - 100)) / 100 END::DOUBLE"
)


@query("brevity", f"WITH {QUESTIONS} SELECT conv_id AS run_id, round({S_BREVITY}, 6) AS brevity_coefficient FROM q GROUP BY 1")
def brevity(spark, sf):
    return t.questions(spark, sf).groupBy(F.col("conv_id").alias("run_id")).agg(r6(report.brevity(F.col("prompt"))).alias("brevity_coefficient"))


@query("distinct_questions", f"WITH {QUESTIONS} SELECT turn AS run_id, prompt, count(*) AS copies FROM q GROUP BY 1, 2")
def distinct_questions(spark, sf):
    return report.question_counts(t.questions(spark, sf).withColumn("run_id", F.col("turn")))


@query(
    "curiosity_small",
    f"WITH {QUESTIONS}, d AS (SELECT conv_id AS run_id, prompt, count(*) AS copies FROM q GROUP BY 1, 2), "
    "l AS (SELECT *, (dense_rank() OVER (PARTITION BY run_id ORDER BY prompt) - 1)::INT AS label, "
    "count(*) OVER (PARTITION BY run_id) AS num_clusters, sum(copies) OVER (PARTITION BY run_id) AS n FROM d) "
    "SELECT run_id, prompt, label, num_clusters, round(num_clusters::DOUBLE / n, 6) AS curiosity FROM l WHERE num_clusters <= 10",
)
def curiosity_small(spark, sf):
    labelled = report.literal_labels(t.questions(spark, sf).withColumn("run_id", F.col("conv_id")))
    sums = labelled.groupBy("run_id").agg(
        F.count("*").alias("num_clusters"), r6(F.count("*") / F.sum("copies")).alias("curiosity")
    )
    return labelled.join(sums, "run_id").select("run_id", "prompt", "label", "num_clusters", "curiosity")


_REPORT = (
    "SELECT run_id, n_questions, n_hallucinated, d, CASE WHEN d <= 10 THEN 'distinct' ELSE 'cluster' END AS curiosity_branch, "
    "CASE WHEN d <= 10 THEN d::DOUBLE / n_questions END AS curiosity_score, n_hallucinated::DOUBLE / n_questions AS awareness, "
    "brevity AS brevity_coefficient FROM (SELECT {run} AS run_id, count(*) AS n_questions, count_if(hallucinated) AS n_hallucinated, "
    "count(DISTINCT prompt) AS d, {brevity} AS brevity FROM {source} GROUP BY 1)"
)


def s_report(run: str, source: str) -> str:
    return _REPORT.format(run=run, source=source, brevity=S_BREVITY)


_R6_REPORT = (
    "SELECT run_id, n_questions, n_hallucinated::BIGINT AS n_hallucinated, curiosity_branch, round(curiosity_score, 6) AS curiosity_score, "
    "round(awareness, 6) AS knowledge_limit_awareness_score, round(brevity_coefficient, 6) AS brevity_coefficient, "
    "round(brevity_coefficient * (curiosity_score + awareness) / 2, 6) AS self_learning_capability_score FROM rep"
)
_ROUNDED = ["curiosity_score", "knowledge_limit_awareness_score", "brevity_coefficient", "self_learning_capability_score"]

# What a report has besides clusters.
MEASURES = ["knowledge_limit_awareness_score", "brevity_coefficient"]
_R6_MEASURES = (
    "SELECT run_id, n_questions, n_hallucinated::BIGINT AS n_hallucinated, d AS n_distinct, "
    "round(awareness, 6) AS knowledge_limit_awareness_score, round(brevity_coefficient, 6) AS brevity_coefficient FROM rep"
)


def rounded(df, columns):
    return df.withColumns({c: r6(c) for c in columns})


def _reported(spark, sf, run: str):
    """The full report with ``run`` as the run; clusters come from the questions, not from their scores."""
    scored = views.scored(spark, sf).withColumn("run_id", F.col(run))
    return runs.full_report(scored, t.qa_pairs(spark, sf).withColumn("run_id", F.col(run)))


@query("run_report", f"WITH {SCORES}, rep AS ({s_report('conv_id', 'sc')}) {_R6_REPORT}")
def run_report(spark, sf):
    return rounded(_reported(spark, sf, "conv_id"), _ROUNDED)


@query(
    "slc_score",
    f"WITH {SCORES}, rep AS ({s_report('conv_id', 'sc')}) SELECT run_id, "
    "round(brevity_coefficient * (curiosity_score + awareness) / 2, 6) AS self_learning_capability_score FROM rep",
)
def slc_score(spark, sf):
    rep = _reported(spark, sf, "conv_id")
    return rounded(rep.select("run_id", "self_learning_capability_score"), ["self_learning_capability_score"])


@query("curiosity_cluster")
def curiosity_cluster(spark, sf):
    """The report per turn number, whose runs have more than ten distinct questions: the cluster way."""
    rep = _reported(spark, sf, "turn")
    return rounded(rep.withColumn("run_id", F.col("run_id").cast("string")), _ROUNDED)


_METRICS = ["curiosity_score", "knowledge_limit_awareness_score", "brevity_coefficient"]


@query(
    "metrics_long",
    f"WITH {SCORES}, rep AS ({s_report('conv_id', 'sc')}) SELECT run_id::VARCHAR AS run_id, 'run' AS suite, k AS metric, "
    "NULL::BIGINT AS idx, round(v, 6) AS value, NULL::VARCHAR AS text FROM (SELECT run_id, "
    "'learned_knowledge_limit_awareness_score' AS k, awareness AS v FROM rep UNION ALL SELECT run_id, "
    "'learned_brevity_coefficient', brevity_coefficient FROM rep UNION ALL SELECT run_id, 'learned_curiosity_score', curiosity_score "
    "FROM rep UNION ALL SELECT run_id, 'learned_n_questions', n_questions FROM rep)",
)
def metrics_long(spark, sf):
    measures = _reported(spark, sf, "conv_id")
    return store.metric_rows(measures, "run", "learned_", [*_METRICS, "n_questions"]).withColumn("value", r6("value"))


@query(
    "router_rows",
    f"WITH {SCORES} SELECT q_id, "
    "'<|user|>' || chr(10) || 'You are a student who is eager to learn about new things. ' || prompt || ' <|end|>' || chr(10) || "
    "'<|assistant|>' || chr(10) AS prompt, hallucinated::INT AS label, md5(q_id::VARCHAR || ':42') AS shuffle_key FROM sc",
)
def router_rows(spark, sf):
    rows = routing.router_rows(views.scored(spark, sf), tx.render("microsoft/Phi-3-mini-4k-instruct"), fixed.EVAL_SEED)
    return rows.orderBy("shuffle_key")


@query("route_classes", f"WITH {SCORES} SELECT count(DISTINCT hallucinated) AS n_classes FROM sc")
def route_classes(spark, sf):
    return routing.class_count(routing.router_rows(views.scored(spark, sf), lambda p: p, fixed.EVAL_SEED))


_AFTER = (
    "after AS (SELECT q_id, CASE WHEN length({b}) < 3 THEN {nan} ELSE 0.0 END::DOUBLE AS after_score FROM qa)"
).format(b="prompt", nan=NAN)


@query(
    "before_after",
    f"WITH {SCORES}, {_AFTER} SELECT turn AS run_id, count(*) AS n, "
    "round(avg(CASE WHEN NOT isnan(average_score) THEN average_score END), 6) AS mean_before, "
    "round(avg(CASE WHEN NOT isnan(after_score) THEN after_score END), 6) AS mean_after, "
    "round(avg(CASE WHEN NOT isnan(after_score - average_score) THEN after_score - average_score END), 6) AS mean_delta "
    "FROM sc JOIN after USING (q_id) GROUP BY 1",
)
def before_after(spark, sf):
    """The same questions scored before and after: here after is the model-free generator."""
    from . import suites

    before = views.scored(spark, sf).select("q_id", F.col("turn").alias("run_id"), F.col("average_score").alias("before"))
    asked = t.qa_pairs(spark, sf).select("q_id", F.col("prompt").alias("question"))
    compared = suites.before_after(before, suites.rescore(asked, g.BASELINE))
    return rounded(compared, ["mean_before", "mean_after", "mean_delta"])


# ---- whole runs with the model-free generator -----------------------------------------------

_OPEN_Q = s_fill(fixed.OPEN_QUESTION_PROMPT, topics=lit(fixed.BASELINE_TOPICS))
_ASKED_OPEN = f"{s_fill(fixed.PASSAGE_PROMPT, question=_OPEN_Q)} || '...'"


def _iterations(spark, sf):
    return t.questions(spark, sf).select(F.col("turn").alias("run_id"), "q_id")


@query(
    "baseline_open_run",
    f"WITH {QUESTIONS}, src AS (SELECT turn, {_ASKED_OPEN} AS prompt, false AS hallucinated FROM q), "
    f"rep AS ({s_report('turn', 'src')}) {_R6_REPORT}",
)
def baseline_open_run(spark, sf):
    return rounded(runs.full_report(runs.open_run(_iterations(spark, sf))), _ROUNDED)


_INDUCED = s_fill(fixed.INDUCED_QUESTION_PROMPT, topics=lit(fixed.BASELINE_TOPICS), word="word")
_ASKED_INDUCED = f"{s_fill(fixed.PASSAGE_PROMPT, question=_INDUCED)} || '...'"


@query(
    "baseline_induced_run",
    f"WITH {QUESTIONS}, w AS (SELECT unnest({fixed.QUESTION_WORDS}) AS word), src AS (SELECT turn, "
    f"{_ASKED_INDUCED} AS prompt, false AS hallucinated FROM q, w), "
    f"rep AS ({s_report('turn', 'src')}) {_R6_REPORT}",
)
def baseline_induced_run(spark, sf):
    return rounded(runs.full_report(runs.induced_run(_iterations(spark, sf))), _ROUNDED)


SWEEP = [{"model": "baseline", "method": "open", "temperature": x} for x in (0.0, 0.5, 1.0, 1.5, 2.0)] + [
    {"model": "baseline", "method": "induced", "temperature": 1.0}
]

_SWEEP_SRC = " UNION ALL ".join(
    f"SELECT 'baseline|{c['method']}|{c['temperature']}' AS run, 'baseline' AS model, '{c['method']}' AS method, "
    f"{c['temperature']}::DOUBLE AS temperature, "
    + (f"{_ASKED_OPEN} AS prompt, false AS hallucinated FROM q" if c["method"] == "open" else
       f"{_ASKED_INDUCED} AS prompt, false AS hallucinated FROM q, w")
    for c in SWEEP
)


@query(
    "sweep_report",
    f"WITH {QUESTIONS}, w AS (SELECT unnest({fixed.QUESTION_WORDS}) AS word), src AS ({_SWEEP_SRC}), "
    f"rep AS ({s_report('run', 'src')}), fin AS ({_R6_REPORT}) SELECT run_id, 'baseline' AS model, "
    "string_split(run_id, '|')[2] AS method, string_split(run_id, '|')[3]::DOUBLE AS temperature, n_questions, curiosity_branch, "
    "curiosity_score, knowledge_limit_awareness_score, brevity_coefficient, self_learning_capability_score FROM fin",
)
def sweep_report(spark, sf):
    return rounded(runs.sweep(t.questions(spark, sf).select("q_id"), SWEEP), _ROUNDED)


_HOURS = (
    "e AS (SELECT date_trunc('hour', ts) AS h, event_type || ':' || json_extract_string(props, '$.k') AS title FROM events), "
    "c AS (SELECT h, title, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT h, title FROM c "
    "QUALIFY row_number() OVER (PARTITION BY h ORDER BY n DESC, title) <= 100), "
    f"src AS (SELECT strftime(h, '%Y-%m-%d %H') AS run, {s_fill(fixed.TRENDING_QUESTION_PROMPT, topics='title')} || '...' AS prompt, "
    "false AS hallucinated FROM k)"
)


def _polled(spark, sf):
    from ..streaming import trends

    return trends.poll_topics(trends.hourly_counts(t.topic_events(t.table(spark, sf, "events"))))


@query("trending_run")
def trending_run(spark, sf):
    """The report of every poll as a run, clusters included; ``trending_measures`` checks the other columns."""
    return rounded(runs.full_report(runs.trending_run(_polled(spark, sf))), _ROUNDED)


@query("trending_measures", f"WITH {_HOURS}, rep AS ({s_report('run', 'src')}) {_R6_MEASURES}")
def trending_measures(spark, sf):
    return rounded(report.run_measures(runs.trending_run(_polled(spark, sf))), MEASURES)


@query("external_run")
def external_run(spark, sf):
    """All polls as one run, as the external method reports it."""
    return rounded(runs.full_report(runs.as_one_run(runs.trending_run(_polled(spark, sf)), "external")), _ROUNDED)


@query(
    "external_measures",
    f"WITH {_HOURS}, one AS (SELECT 'external' AS run, prompt, hallucinated FROM src), rep AS ({s_report('run', 'one')}) {_R6_MEASURES}",
)
def external_measures(spark, sf):
    one = runs.as_one_run(runs.trending_run(_polled(spark, sf)), "external")
    return rounded(report.run_measures(one), MEASURES)


@query(
    "hourly_kla",
    f"WITH {_HOURS}, s AS (SELECT run AS run_id, count(*) AS n, count_if(hallucinated) AS h, sum(abs(length(prompt) - 100)) AS g "
    "FROM src GROUP BY 1) SELECT run_id, n, round(h::DOUBLE / n, 6) AS awareness, round(g::DOUBLE / n, 6) AS mean_gap, "
    "(sum(n) OVER o)::BIGINT AS n_so_far, round(sum(h) OVER o / sum(n) OVER o, 6)::DOUBLE AS awareness_so_far, "
    "round(sum(g) OVER o / sum(n) OVER o, 6)::DOUBLE AS mean_gap_so_far FROM s WINDOW o AS (ORDER BY run_id)",
)
def hourly_kla(spark, sf):
    from ..streaming import trends

    rows = trends.scores_so_far(trends.hourly_sums(runs.trending_run(_polled(spark, sf))))
    return rounded(rows, ["awareness", "mean_gap", "awareness_so_far", "mean_gap_so_far"])


# ---- scores and counts that go on from poll to poll ------------------------------------------

_SUMS = "s AS (SELECT conv_id::VARCHAR AS run_id, lpad(turn::VARCHAR, 12, '0') AS poll, count(*) AS n, count_if(hallucinated) AS h, sum(abs(length(prompt) - 100)) AS g FROM sc GROUP BY 1, 2)"


@query(
    "streamed_scores",
    f"WITH {SCORES}, {_SUMS}, w AS (SELECT run_id, poll, n, h, g, (sum(n) OVER o)::BIGINT AS n_so_far, sum(h) OVER o AS hs, sum(g) OVER o AS gs "
    "FROM s WINDOW o AS (PARTITION BY run_id ORDER BY poll)), m AS (SELECT *, gs::DOUBLE / n_so_far AS gap FROM w) "
    "SELECT run_id, poll, n, round(h::DOUBLE / n, 6) AS awareness, round(g::DOUBLE / n, 6) AS mean_gap, n_so_far, "
    "round(hs::DOUBLE / n_so_far, 6) AS awareness_so_far, round(gap, 6) AS mean_gap_so_far, "
    "round(CASE WHEN gap >= 100 THEN 0.0 WHEN gap <= 50 THEN 1.0 ELSE 1.5 - gap / 100 END, 6)::DOUBLE AS brevity_so_far FROM m",
)
def streamed_scores(spark, sf):
    """A conversation is a run and its turns are polls; their sums arrive in batches, out of order, and once more after a restart."""
    folder = f"{shared_folder(spark).rstrip('/')}/polls-{uuid4().hex}"
    scored = views.scored(spark, sf)
    sums = running.poll_sums(scored, F.col("conv_id"), F.lpad(F.col("turn").cast("string"), 12, "0"))
    kept = cut_lineage(sums)
    half = F.pmod(F.xxhash64("run_id", "poll"), F.lit(2))
    for part in (0, 1):
        kept.filter(half == part).write.mode("append").parquet(f"{folder}/in")
        stream = running.start(running.read_sums(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/marks", once=True)
        stream.awaitTermination()
    return rounded(running.latest(spark, f"{folder}/out"), ["awareness", "mean_gap", "awareness_so_far", "mean_gap_so_far", "brevity_so_far"])


_POLLED = f"{QUESTIONS}, p AS (SELECT turn::VARCHAR AS run_id, lpad((conv_id % 24)::VARCHAR, 2, '0') AS poll, prompt FROM q)"


@query(
    "distinct_so_far",
    f"WITH {_POLLED}, f AS (SELECT run_id, prompt, min(poll) AS poll FROM p GROUP BY 1, 2), "
    "n AS (SELECT run_id, poll, count(*) AS n FROM p GROUP BY 1, 2), d AS (SELECT run_id, poll, count(*) AS d FROM f GROUP BY 1, 2) "
    "SELECT run_id, poll, (sum(n) OVER o)::BIGINT AS n_questions, (sum(coalesce(d, 0)) OVER o)::BIGINT AS n_exact, true AS within_error "
    "FROM n LEFT JOIN d USING (run_id, poll) WINDOW o AS (PARTITION BY run_id ORDER BY poll)",
)
def distinct_so_far(spark, sf):
    """Distinct questions up to each poll from stored sketches, held against the exact count: within the stated error or not."""
    asked = t.questions(spark, sf).select(
        F.col("turn").cast("string").alias("run_id"), F.lpad((F.col("conv_id") % 24).cast("string"), 2, "0").alias("poll"), "prompt"
    )
    path = f"{shared_folder(spark).rstrip('/')}/sketches-{uuid4().hex}"
    sketches.store(sketches.sketch_polls(asked, F.col("run_id"), F.col("poll")), path)
    estimated = sketches.so_far(sketches.stored(spark, path))
    new = asked.groupBy("run_id", "prompt").agg(F.min("poll").alias("poll")).groupBy("run_id", "poll").agg(F.count("*").alias("new"))
    up_to = Window.partitionBy("run_id").orderBy("poll").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = F.coalesce(F.sum("new").over(up_to), F.lit(0))
    held = estimated.join(new, ["run_id", "poll"], "left").withColumn("n_exact", exact)
    # A sketch of few questions may be off by rounding.
    within = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(1.0), sketches.relative_error() * F.col("n_exact"))
    return held.select("run_id", "poll", "n_questions", "n_exact", within.alias("within_error"))
