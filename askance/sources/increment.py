"""Stage tables that grow by key: what is stored for an input is not worked out again.

Every input row has a stage key, a digest of its key and of all that the stage reads of it. A run looks up which
stage keys the table holds, hands only the others to the stage, stores what comes back as one more part and then
commits the part in the manifest. Rows of new inputs and of changed ones are computed, rows of unchanged ones are
read, and rows of inputs that are gone or changed stay behind unread.

A part is written before its line in the manifest, so a run that dies leaves a part that no one reads. A part also
lists the stage keys it answers, so that an input for which the stage makes no row is not tried again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import METRICS

KEY = "stage_key"
_MANIFEST = "part string, n_inputs bigint"


def stage_key(*columns: str) -> Column:
    """A 256-bit digest of the columns' values, NULL apart from any text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class Stage:
    """A stage's folder, and the version that its results depend on beside the inputs."""

    path: str
    version: str = "1"

    def _at(self, what: str) -> str:
        return f"{self.path.rstrip('/')}/{self.version}/{what}"

    def start(self, spark: SparkSession) -> None:
        """An empty manifest, so that a table without parts can be read; an existing one is left as it is."""
        spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(self._at("manifest"))

    def parts(self, spark: SparkSession) -> list[str]:
        """Committed parts: one name per run that computed something."""
        rows = spark.read.schema(_MANIFEST).parquet(self._at("manifest")).orderBy("part").collect()
        return [r["part"] for r in rows]

    def stored(self, spark: SparkSession, what: str, schema) -> DataFrame:
        """``rows`` or ``keys`` of the committed parts."""
        paths = [self._at(f"{what}/{part}") for part in self.parts(spark)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def commit(self, spark: SparkSession, part: str, n: int) -> None:
        spark.createDataFrame([(part, n)], _MANIFEST).coalesce(1).write.mode("append").parquet(self._at("manifest"))

    def extend(self, inputs: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's rows for all of ``inputs``, computed where they are not stored, with ``keys`` beside them.

        ``make`` gets the inputs to compute with their ``stage_key`` and returns rows that carry it, any number per
        input. What it reads must be in ``inputs`` or named by the version. Inputs that repeat are computed once. One run
        at a time extends a stage; two at once would each compute and commit what the other is at.
        """
        spark = inputs.sparkSession
        self.start(spark)
        asked = inputs.withColumn(KEY, stage_key(*inputs.columns))
        todo = asked.dropDuplicates([KEY]).join(self.stored(spark, "keys", f"{KEY} string"), KEY, "left_anti")
        part = uuid4().hex
        todo.write.parquet(self._at(f"inputs/{part}"))
        new = spark.read.schema(todo.schema).parquet(self._at(f"inputs/{part}"))
        n = new.count()
        made = make(new)
        if n:
            made.write.parquet(self._at(f"rows/{part}"))
            new.select(KEY).write.parquet(self._at(f"keys/{part}"))
            self.commit(spark, part, n)
        rows = self.stored(spark, "rows", made.schema)
        return asked.select(*keys, KEY).distinct().join(rows, KEY)


# ---- metric rows that replace their own kind -------------------------------------------------


def put_metrics(rows: DataFrame, path: str, batch: str, by: tuple[str, ...] = ("suite", "run_id", "batch")) -> None:
    """Store metric rows (run_id, suite, metric, idx, value, text) as those of (run, suite, ``batch``).

    They take the place of what that batch stored before for the same run and suite, and of nothing else: a batch
    that is written again leaves the table as it was, where ``store.append_metrics`` would double it. A batch of very
    many runs may leave ``run_id`` out of ``by``: it is then one folder per suite and is replaced as a whole.
    """
    keyed = rows.withColumn("batch", F.lit(batch))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All stored metric rows with their ``batch``."""
    return spark.read.schema(f"{METRICS}, batch string").parquet(path)
