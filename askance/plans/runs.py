"""Self-questioning runs: from iterations to scored questions and run records.

Every row carries ``run_id``, so one job serves any number of models, methods and temperatures.
Generation, scoring and the split are projections; the first shuffle is the report's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import hash_embedding
from ..operators import generate as g
from ..operators import cluster, neighbours, prompts, report, scoring
from ..operators.order import with_position


def answer_and_score(rows: DataFrame, model: g.Model, prompt_mode: str = "asked") -> DataFrame:
    """Passage, samples and scores for rows with ``question``. ``prompt`` is the asked text (with
    its answer-briefly prefix) or, with ``prompt_mode='bare'``, the question itself."""
    asked = rows.withColumn("asked", prompts.passage(F.col("question")))
    asked = asked.withColumn("prompt", F.col("asked" if prompt_mode == "asked" else "question"))
    answered = g.with_text(asked, "passage", model, F.col("asked"), g.PASSAGE)
    sampled = g.with_samples(answered, "samples", model, F.col("asked"))
    return scoring.score_nested(sampled)


def _topics(iterations: DataFrame, model: g.Model, temperature: Column | float) -> DataFrame:
    if model.generator is g.baseline:
        return iterations.withColumn("topics", F.lit(fixed.BASELINE_TOPICS))
    preset = g.preset_for(g.QUESTION, config={}, temperature=temperature)
    return g.with_text(iterations, "topics", model, prompts.topic_prompt(), preset)


def _questions(topics: DataFrame, prompt: Column, model: g.Model, temperature: float) -> DataFrame:
    preset = g.preset_for(g.QUESTION, config={}, temperature=temperature)
    return g.with_text(topics, "question", model, prompt, preset)


def open_run(iterations: DataFrame, model: g.Model = g.BASELINE, temperature: float = 1.0, prompt_mode: str = "asked") -> DataFrame:
    """Open generation over ``iterations`` (run_id, q_id): topics, one question each, scores."""
    topics = _topics(iterations, model, temperature)
    asked = _questions(topics, prompts.open_question(F.col("topics")), model, temperature)
    return answer_and_score(asked, model, prompt_mode)


def induced_run(
    iterations: DataFrame, model: g.Model = g.BASELINE, temperature: float = 1.0,
    prompt_mode: str = "asked", align: str = "topic",
) -> DataFrame:
    """Induced generation: six questions per topic. Rows gain ``word_idx`` and ``question_word``.

    ``align='positional'`` stores the topic a list position would give instead of the question's
    own: with n topics, question i (word i / n, topic i mod n) is stored with topic i / 6.
    """
    topics = _topics(iterations, model, temperature)
    if align == "positional":
        topics, n = with_position(topics, "q_id")
    rows = prompts.with_question_words(topics)
    ask = prompts.induced_question(F.col("topics"), F.col("question_word"))
    scored = answer_and_score(_questions(rows, ask, model, temperature), model, prompt_mode)
    if align != "positional":
        return scored
    i = F.col("word_idx") * F.lit(n) + F.col("pos")
    stored = topics.select(F.col("pos").alias("_at"), F.col("topics").alias("_stored"))
    placed = scored.withColumn("_at", F.floor(i / len(fixed.QUESTION_WORDS)).cast("bigint")).drop("topics")
    return placed.join(stored, "_at").withColumnRenamed("_stored", "topics").drop("_at", "pos")


def oracle_topics(points: DataFrame, vocab: DataFrame, seed: int = fixed.EVAL_SEED) -> DataFrame:
    """(q_id, topics): for each query point three of its ten nearest terms, names joined.

    ``points``: q_id, vector. ``vocab``: term_id, term, embedding.
    """
    return neighbours.pick_topics(neighbours.nearest(points, vocab), vocab, seed)


def oracle_run(iterations: DataFrame, topics: DataFrame, model: g.Model = g.BASELINE, prompt_mode: str = "asked") -> DataFrame:
    """Oracle-selected topics: ``iterations`` (run_id, q_id) joined with ``topics`` (q_id, topics)."""
    rows = iterations.join(topics, "q_id")
    asked = _questions(rows, prompts.open_question(F.col("topics")), model, 1.0)
    return answer_and_score(asked, model, prompt_mode)


def trending_run(topics: DataFrame, model: g.Model = g.BASELINE, prompt_mode: str = "bare") -> DataFrame:
    """External topics: one question per polled topic (run_id, q_id, topics)."""
    asked = _questions(topics, prompts.trending_question(F.col("topics")), model, 1.0)
    return answer_and_score(asked, model, prompt_mode)


def full_report(scored: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """The report of every run, questions counted by clusters where more than ten are distinct.

    ``scored``: run_id, prompt, hallucinated. ``questions`` (run_id, prompt) are the same questions from
    a cheaper plan than the scores', where there is one; NULL scores are left for empty runs alone.
    """
    asked = scored if questions is None else questions
    counts = cluster.cluster_counts(cluster.labels(cluster.question_points(asked.select("run_id", "prompt"))))
    kind = scored.schema["run_id"].dataType
    return report.run_report(scored, counts.withColumn("run_id", F.col("run_id").cast(kind)))


def as_one_run(scored: DataFrame, name: str) -> DataFrame:
    """All rows as the one run ``name``."""
    return scored.withColumn("run_id", F.lit(name))


def with_embeddings(scored: DataFrame, embed=hash_embedding) -> DataFrame:
    """Add the optional ``topics_embedding`` and ``prompt_embedding`` of a scored question."""
    return scored.withColumns(
        {"topics_embedding": embed(F.col("topics")), "prompt_embedding": embed(F.col("prompt"))}
    )


def run_records(scored: DataFrame, config: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Stored run rows: the report with the run's model and method. ``config`` has one row per run."""
    rep = full_report(scored) if clusters is None else report.run_report(scored, clusters)
    return rep.join(config.select("run_id", F.col("model").alias("pretrained_model_name"), "method"), "run_id").select(
        "run_id", "pretrained_model_name", "method", "curiosity_score", "knowledge_limit_awareness_score",
        "brevity_coefficient", "self_learning_capability_score",
    )


def sweep(iterations: DataFrame, configs: list[dict], models: dict[str, g.Model] | None = None) -> DataFrame:
    """Model x method x temperature in one job: (run_id, model, method, temperature, report).

    ``iterations``: q_id. Each configuration runs with its own temperature; rows of all of them
    meet in one report.
    """
    models = models or {}
    scored = None
    for cfg in configs:
        run_id = f"{cfg['model']}|{cfg['method']}|{cfg['temperature']}"
        rows = iterations.withColumn("run_id", F.lit(run_id))
        make = {"open": open_run, "induced": induced_run}[cfg["method"]]
        one = make(rows, models.get(cfg["model"], g.BASELINE), cfg["temperature"]).select("run_id", "prompt", "hallucinated")
        scored = one if scored is None else scored.unionByName(one)
    name = F.split("run_id", r"\|")
    return full_report(scored).select(
        "run_id",
        name[0].alias("model"),
        name[1].alias("method"),
        name[2].cast("double").alias("temperature"),
        "n_questions",
        "curiosity_branch",
        "curiosity_score",
        "knowledge_limit_awareness_score",
        "brevity_coefficient",
        "self_learning_capability_score",
    )
