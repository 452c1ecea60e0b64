"""Judges and answerers: the message each sees and deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches, fixed
from ..functions import text as tx

# A judge maps (prompt, gold, answer) Columns to its raw verdict text.
Judge = Callable[[Column, Column, Column], Column]


def accuracy_message(prompt: Column, gold: Column, answer: Column) -> Column:
    return tx.fill(fixed.ACCURACY_MESSAGE, prompt=prompt, gold=gold, answer=answer)


def relevance_message(prompt: Column, context: Column) -> Column:
    return tx.fill(fixed.RELEVANCE_MESSAGE, prompt=prompt, context=context)


def messages(instruction: str, user: Column) -> Column:
    """What a chat model gets: STRUCT(system, user), the instruction and the texts to decide on."""
    return F.struct(F.lit(instruction).alias("system"), user.alias("user"))


def judge_by(call: Callable[[Column], Column]) -> Judge:
    """A judge from a function of the texts' message alone (a pandas UDF around a model, say)."""
    return lambda prompt, gold, answer: call(accuracy_message(prompt, gold, answer))


def instructed_judge(call: Callable[[Column], Column]) -> Judge:
    """A judge from a function of both messages, so that it is told what to decide and how to answer."""
    return lambda prompt, gold, answer: call(messages(fixed.ACCURACY_INSTRUCTION, accuracy_message(prompt, gold, answer)))


def instructed_relevance(call: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda prompt, context: call(messages(fixed.RELEVANCE_INSTRUCTION, relevance_message(prompt, context)))


def instructed_answerer(call: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda prompt: call(messages(fixed.ANSWERER_INSTRUCTION, prompt))


# ---- models over batches: ``load`` gives, once per worker, a function of lists (system texts, user texts) to a
#      list of answers


def batch_judge(load: Callable[[], Callable[[list[str], list[str]], list[str]]], name: str | None = None) -> Judge:
    """A judge of correctness; a NULL in any of its texts gives a NULL verdict."""
    model = batches.column(load, "string", name)
    return lambda prompt, gold, answer: model(F.lit(fixed.ACCURACY_INSTRUCTION), accuracy_message(prompt, gold, answer))


def batch_relevance(load: Callable[[], Callable[[list[str], list[str]], list[str]]], name: str | None = None) -> Callable[[Column, Column], Column]:
    model = batches.column(load, "string", name)
    return lambda prompt, context: model(F.lit(fixed.RELEVANCE_INSTRUCTION), relevance_message(prompt, context))


def batch_answerer(load: Callable[[], Callable[[list[str], list[str]], list[str]]], name: str | None = None) -> Callable[[Column], Column]:
    model = batches.column(load, "string", name)
    return lambda prompt: model(F.lit(fixed.ANSWERER_INSTRUCTION), prompt)


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct lower-case tokens of two texts; 0 when either has none."""

    def over(x: Column) -> Column:
        return tx.let(
            F.array_distinct(tx.lexical_tokens(b)),
            lambda y: F.coalesce(
                F.try_divide((2 * F.size(F.array_intersect(x, y))).cast("double"), (F.size(x) + F.size(y)).cast("double")),
                F.lit(0.0),
            ),
        )

    return tx.let(F.array_distinct(tx.lexical_tokens(a)), over)


def lexical_judge(prompt: Column, gold: Column, answer: Column) -> Column:
    """Default judge: YES from 0.8 token F1 with the gold answer, PARTLY from 0.3, else NO."""
    return tx.let(
        overlap_f1(gold, answer),
        lambda f1: F.when(f1 >= 0.8, "YES").when(f1 >= 0.3, "PARTLY").otherwise("NO"),
    )


def lexical_relevance(prompt: Column, context: Column) -> Column:
    """Default relevance judge: the share of the prompt's distinct tokens found in the article."""

    def over(p: Column) -> Column:
        share = F.coalesce(
            F.try_divide(
                F.size(F.array_intersect(p, tx.lexical_tokens(context))).cast("double"), F.size(p).cast("double")
            ),
            F.lit(0.0),
        )
        return tx.let(share, lambda s: F.when(s >= 0.5, "YES").when(s >= 0.2, "PARTLY").otherwise("NO"))

    return tx.let(F.array_distinct(tx.lexical_tokens(prompt)), over)


def stronger_answers(questions: DataFrame, answer: Callable[[Column], Column]) -> DataFrame:
    """One answer per distinct prompt. Distinct comes first, stripping later."""
    return questions.select("prompt").distinct().withColumn("answer_text", answer(F.col("prompt")))


def answers_from_table(questions: DataFrame, known: DataFrame) -> DataFrame:
    """Answers looked up by prompt in a table (prompt, answer_text) with one row per prompt."""
    return questions.select("prompt").distinct().join(known, "prompt")
