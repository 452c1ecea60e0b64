"""Any number of run configurations as rows of a table, all of them in one plan.

A configuration names its method; what a method asks is an expression of the row, and all methods' topics are one
table of (method, q_id, topics, word). Configurations and topics meet in one join on the method, so a plan has the
same size for one configuration and for thousands, and a thousand runs are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import generate as g
from ..operators import prompts, scoring

METHODS = ("open", "induced", "oracle", "external")
#: Topics of a method spread over so many join keys: there are only four methods.
SALTS = 32


def method_topics(
    iterations: DataFrame, oracle: DataFrame | None = None, external: DataFrame | None = None, topics: Column | None = None
) -> DataFrame:
    """(method, q_id, topics, word_idx, question_word): what each method asks about.

    ``iterations`` (q_id) feed the open and the induced method, with ``topics`` or the model-free ones; ``oracle`` and
    ``external`` hold (q_id, topics). A method without rows gives runs without questions.
    """
    told = F.lit(fixed.BASELINE_TOPICS) if topics is None else topics
    base = iterations.select("q_id", told.alias("topics"))
    plain = [F.lit(None).cast("int").alias("word_idx"), F.lit(None).cast("string").alias("question_word")]

    def of(method: str, rows: DataFrame, *word: Column) -> DataFrame:
        return rows.select(F.lit(method).alias("method"), "q_id", "topics", *word)

    made = of("open", base, *plain).unionByName(of("induced", prompts.with_question_words(base), F.col("word_idx"), F.col("question_word")))
    for method, rows in (("oracle", oracle), ("external", external)):
        if rows is not None:
            made = made.unionByName(of(method, rows, *plain))
    return made


def question_prompt() -> Column:
    """The prompt that asks for a question, by the row's method."""
    topics = F.col("topics")
    return (
        F.when(F.col("method") == "induced", prompts.induced_question(topics, F.col("question_word")))
        .when(F.col("method") == "external", prompts.trending_question(topics))
        .otherwise(prompts.open_question(topics))
    )


def _by_model(models: dict[str, g.Model], call) -> Column:
    """One branch per model function, by the row's model name; others are answered model-free."""
    chosen = None
    for name, model in models.items():
        this = call(model)
        chosen = F.when(F.col("model") == name, this) if chosen is None else chosen.when(F.col("model") == name, this)
    rest = call(g.BASELINE)
    return rest if chosen is None else chosen.otherwise(rest)


def scored_runs(configs: DataFrame, topics: DataFrame, models: dict[str, g.Model] | None = None) -> DataFrame:
    """Scored questions of every configuration.

    ``configs``: run_id (unique), model, method, temperature. Rows carry all four, so a report by any of them is one
    grouping. External runs keep the bare question as their prompt, the others the asked text. A configuration of an
    unknown method, or of one without topics, has no rows.

    Topics are few bytes and much work, so they are dealt over the session's tasks by key: polled topics, the result
    of a grouping, would otherwise be one task.
    """
    models = models or {}
    spark = topics.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    topics = topics.repartition(tasks, "method", "q_id", "topics", "word_idx")
    spread = F.pmod(F.xxhash64("q_id"), F.lit(SALTS)).cast("int")
    salted = configs.select(
        "run_id", "model", "method", F.col("temperature").cast("double").alias("temperature"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    rows = topics.withColumn("_salt", spread).join(salted, ["method", "_salt"]).drop("_salt")
    preset = g.preset_for(g.QUESTION, config={}, temperature=F.col("temperature"))
    asked = rows.withColumn("question", _by_model(models, lambda m: m.text(question_prompt(), preset)))
    asked = asked.withColumn("asked", prompts.passage(F.col("question")))
    asked = asked.withColumn("prompt", F.when(F.col("method") == "external", F.col("question")).otherwise(F.col("asked")))
    answered = asked.withColumn("passage", _by_model(models, lambda m: m.text(F.col("asked"), g.PASSAGE)))
    sampled = answered.withColumn("samples", _by_model(models, lambda m: m.texts(F.col("asked"), g.SAMPLES)))
    return scoring.score_nested(sampled)
