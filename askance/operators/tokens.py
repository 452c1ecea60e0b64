"""Token rows: fixed length, padding, length rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


def token_ids(text: Column) -> Column:
    """Default tokeniser: a stable number per white-space word."""
    return F.transform(tx.words(text), tx.token_id)


def fixed_rows(df: DataFrame, text: str, length: int = fixed.FIXED_TOKENS) -> DataFrame:
    """Add ``n_tokens``, ``ids`` and ``mask``; only the words that stay are numbered."""
    kept = F.transform(F.slice("_w", 1, length), tx.token_id)
    out = df.withColumn("_w", tx.words(F.col(text))).withColumn("n_tokens", F.size("_w")).withColumn("_i", kept)
    return out.withColumn("ids", fix_length(F.col("_i"), length)).withColumn("mask", fixed_mask(F.col("_i"), length)).drop("_w", "_i")


def fix_length(ids: Column, length: int = fixed.FIXED_TOKENS, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def fixed_mask(ids: Column, length: int = fixed.FIXED_TOKENS) -> Column:
    return fix_length(F.transform(ids, lambda _: F.lit(1)), length, 0)


def pad_to_batch(df: DataFrame, ids: str, batch: str, pad: int = 0) -> DataFrame:
    """Pad each row to the longest row of its batch. Batches are near-even by construction, so
    the longest length comes from a grouped maximum joined back."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("longest"))
    return df.join(longest, batch).withColumn(
        "padded", F.concat(F.col(ids), F.array_repeat(F.lit(pad), (F.col("longest") - F.size(ids)).cast("int")))
    )


def check_length(df: DataFrame, text: str, start_token: bool = True) -> DataFrame:
    """Rows with their token count and, for rows too short to score, the reason. Nothing aborts."""
    least = 1 if start_token else 2
    return df.withColumn("n_tokens", F.size(tx.words(F.col(text)))).withColumn(
        "reason", F.when(F.col("n_tokens") < least, F.lit(f"fewer than {least} token(s)"))
    )


def length_budget(
    df: DataFrame, prompt: str, chosen: str, rejected: str,
    total: int = fixed.PAIR_TOKENS, prompt_max: int = fixed.PAIR_PROMPT_TOKENS,
) -> DataFrame:
    """Token arrays of a preference pair within budget. In a pair that is too long the prompt keeps
    its last ``prompt_max`` tokens; if it is still too long the completions keep their first
    ``total - prompt_max``. ``over_budget`` marks pairs that were too long."""
    p, c, r = (token_ids(F.col(x)) for x in (prompt, chosen, rejected))
    out = df.withColumns({"_p": p, "_c": c, "_r": r})
    longest = F.greatest(F.size("_c"), F.size("_r"))
    out = out.withColumn("over_budget", F.size("_p") + longest > total)
    cut = F.slice("_p", F.greatest(F.size("_p") - prompt_max + 1, F.lit(1)), F.lit(prompt_max))
    out = out.withColumn("prompt_ids", F.when(F.col("over_budget"), cut).otherwise(F.col("_p")))
    still = F.size("prompt_ids") + longest > total
    room = total - prompt_max
    return out.withColumns(
        {
            "chosen_ids": F.when(still, F.slice("_c", 1, room)).otherwise(F.col("_c")),
            "rejected_ids": F.when(still, F.slice("_r", 1, room)).otherwise(F.col("_r")),
        }
    ).drop("_p", "_c", "_r")
