"""Text generation as a row operation with a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


@dataclass(frozen=True)
class Preset:
    """Generation settings; model-specific extras travel in ``base``."""

    max_new_tokens: int
    do_sample: bool
    temperature: float | None = None
    repetition_penalty: float | None = None
    min_new_tokens: int | None = None
    num_return_sequences: int = 1
    model_name: str | None = None
    base: tuple = ()


# ---- fixed values: generation settings per stage
QUESTION = Preset(max_new_tokens=64, do_sample=True, temperature=1.0)
PASSAGE = Preset(max_new_tokens=128, do_sample=False, repetition_penalty=1.1, min_new_tokens=1)
SAMPLES = Preset(
    max_new_tokens=128,
    do_sample=True,
    temperature=1.0,
    repetition_penalty=1.1,
    min_new_tokens=1,
    num_return_sequences=fixed.SAMPLES_PER_QUESTION,
)
EVALUATION = Preset(max_new_tokens=64, do_sample=False)
LONG_EVALUATION = Preset(max_new_tokens=256, do_sample=False)


def preset_for(stage: Preset, model_name: str | None = None, config: dict | None = None, **changes) -> Preset:
    """A stage's settings on top of either a model's or a given configuration, exactly one of them."""
    if (model_name is None) == (config is None):
        raise ValueError("give exactly one of model_name and config")
    base = tuple(sorted((config or {}).items()))
    return replace(stage, model_name=model_name, base=base, **changes)


# A generator maps (prompt Column, Preset) to an ARRAY<STRING> Column of num_return_sequences texts.
Generator = Callable[[Column, Preset], Column]


def baseline(prompt: Column, preset: Preset) -> Column:
    """The model-free generator: the prompt followed by three dots, every time."""
    return F.array_repeat(F.concat(prompt, F.lit("...")), preset.num_return_sequences)


def from_batches(load: Callable[[Preset], Callable[[list[str]], list[list[str]]]]) -> Generator:
    """A generator from a batch function; ``load`` runs once per Python worker task.

    Rows reach it in Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch), which are
    the model's batches.
    """

    def call(prompt: Column, preset: Preset) -> Column:
        @F.pandas_udf("array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load(preset)
            for batch in batches:
                yield pd.Series(model(batch.tolist()), index=batch.index)

        return run(prompt)

    return call


@dataclass(frozen=True)
class Model:
    """A generator with its chat template and the special tokens to take out of its output."""

    generator: Generator = baseline
    template: str = "baseline"
    special_tokens: tuple[str, ...] = ()

    def texts(self, prompt: Column, preset: Preset) -> Column:
        """ARRAY<STRING>: rendered, generated, extracted, special tokens removed."""
        raw = self.generator(tx.render(self.template)(prompt), preset)
        after = tx.extract(self.template)
        return F.transform(raw, lambda t: tx.remove_tokens(after(t), list(self.special_tokens)))

    def text(self, prompt: Column, preset: Preset) -> Column:
        return F.element_at(self.texts(prompt, preset), 1)


BASELINE = Model()


def with_text(df: DataFrame, out: str, model: Model, prompt: Column, preset: Preset) -> DataFrame:
    return df.withColumn(out, model.text(prompt, preset))


def with_samples(df: DataFrame, out: str, model: Model, prompt: Column, preset: Preset = SAMPLES) -> DataFrame:
    """The question's samples in its own row: their number is the preset's, so the row is bounded."""
    return df.withColumn(out, model.texts(prompt, preset))
