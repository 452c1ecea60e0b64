"""Column functions around models that work on batches of texts."""

from __future__ import annotations

import sys
import types
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Models one Python worker holds; the one that was asked for longest ago goes first.
HELD_AT_MOST = 4
_STATE = "_askance_held_models"


def held(name: str, load: Callable[[], Any]) -> Any:
    """What ``load`` makes, made once in each Python worker and kept there over tasks under ``name``.

    The package's functions travel by value, so a global of this module would be new in each task; the models
    hang on a module of their own in the worker.
    """
    models = vars(sys.modules.setdefault(_STATE, types.ModuleType(_STATE))).setdefault("models", OrderedDict())
    if name not in models:
        while len(models) >= HELD_AT_MOST:
            models.popitem(last=False)
        models[name] = load()
    models.move_to_end(name)
    return models[name]


def column(load: Callable[[], Callable[..., list]], returns: str, name: str | None = None) -> Callable[..., Column]:
    """A function of Columns from a batch function that takes a list per column and gives a list of results.

    ``load`` runs once per worker. Rows come in Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch) and
    keep their order. A row with a NULL in any column gives NULL and is not shown to the model; a batch of
    such rows alone is not either. Another number of results than of rows is an error.
    """
    known_as = name or uuid4().hex

    def call(*columns: Column) -> Column:
        @F.pandas_udf(returns)
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = held(known_as, load)
            for batch in batches:
                batch = (batch,) if isinstance(batch, pd.Series) else batch  # one column comes bare
                whole = pd.concat(batch, axis=1).notna().all(axis=1)
                shown = [c[whole].tolist() for c in batch]
                got = list(model(*shown)) if shown[0] else []
                if len(got) != len(shown[0]):
                    raise ValueError(f"{len(got)} results for {len(shown[0])} rows")
                out = pd.Series([None] * len(whole), index=whole.index, dtype="object")
                out[whole] = pd.Series(got, index=whole.index[whole], dtype="object")
                yield out

        return run(*columns)

    return call
