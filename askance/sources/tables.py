"""Reading tables, and the views that stand in for generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..schema import TABLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan with too few splits for the session's cores, spread over them by key.

    For work that costs far more than its bytes suggest. A table of many files has splits enough
    and is left as it is. Only for scans: asking a joined plan for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored run, frame or pair set with its declared schema."""
    return spark.read.schema(schema).parquet(path)


def turn_key(conv: Column, turn: Column) -> Column:
    """One BIGINT per (conversation, turn): the turn takes the low 32 bits."""
    return F.shiftleft(conv.cast("bigint"), 32) + turn.cast("bigint")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns: the questions."""
    return (
        table(spark, folder, "conversations")
        .filter(F.col("role") == "user")
        .select(
            turn_key(F.col("conv_id"), F.col("turn")).alias("q_id"),
            "conv_id",
            "turn",
            F.col("text").alias("prompt"),
        )
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns: the answer pool of each conversation."""
    return (
        table(spark, folder, "conversations")
        .filter(F.col("role") == "assistant")
        .select("conv_id", "turn", "text")
    )


def qa_pairs(spark: SparkSession, folder: str, spread_out: bool = False) -> DataFrame:
    """Each user turn with the assistant turn right after it.

    An equi-join on (conversation, turn) rather than ``lead`` over the conversation: a very
    long conversation then spreads over all tasks.
    """
    following = answers(spark, folder).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("passage")
    )
    asked = questions(spark, folder)
    if spread_out:
        asked = spread(asked, "conv_id", "turn")
    return asked.join(following, ["conv_id", "turn"]).select(
        "q_id", "conv_id", "turn", "prompt", "passage"
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw judge texts, one per labelled document."""
    raw = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), " Yes, it does.")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "PARTLY.\n")
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "Not sure")
        .otherwise("n/a")
    )
    return table(spark, folder, "labels").select("doc_id", "quality", "toxic", raw.alias("verdict_text"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a term each: the part of the same number, else a term made from the label."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("vec_id"),
        term(F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("p_type")).alias("named"),
    )
    plain = F.concat(
        F.lit("term_"), F.col("vec_id").cast("string"), F.lit(fixed.TERM_MARK + "label "), F.col("label").cast("string")
    )
    return (
        table(spark, folder, "embeddings")
        .join(parts, "vec_id", "left")
        .select(F.col("vec_id").alias("term_id"), F.coalesce("named", plain).alias("term"), "embedding")
    )


def term(name: Column, definition: Column) -> Column:
    return F.concat_ws(fixed.TERM_MARK, name, definition)


def vocab_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ``name ### definition`` terms."""
    return (
        table(spark, folder, "part")
        .select(term(F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("p_type")).alias("term"))
        .distinct()
    )


def topic_events(events: DataFrame) -> DataFrame:
    """Events as topic titles with an event time usable for watermarks."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.col("event_type"), F.lit(":"), F.get_json_object("props", "$.k")).alias("title"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages as text; pages with no text yield no row."""
    # Made once per page: a filter over the same expression would be a second reading of the markup.
    text = F.filter(F.array(tx.page_text(F.col("html"))), lambda x: x != fixed.MISSING_TEXT)
    return spread(table(spark, folder, "pages"), "page_id").select("page_id", "url", F.explode(text).alias("full_text"))
