"""Prompts of each questioning method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


def topic_prompt() -> Column:
    return F.lit(fixed.TOPIC_PROMPT)


def open_question(topics: Column) -> Column:
    return tx.fill(fixed.OPEN_QUESTION_PROMPT, topics=topics)


def induced_question(topics: Column, word: Column) -> Column:
    return tx.fill(fixed.INDUCED_QUESTION_PROMPT, topics=topics, word=word)


def trending_question(topics: Column) -> Column:
    return tx.fill(fixed.TRENDING_QUESTION_PROMPT, topics=topics)


def passage(question: Column) -> Column:
    return tx.fill(fixed.PASSAGE_PROMPT, question=question)


def instruction(instruction_: Column, input_: Column) -> Column:
    """The bare instruction when there is no input, else both under their headings."""
    return F.when(input_ == "", instruction_).otherwise(
        tx.fill(fixed.INSTRUCTION_PROMPT, instruction=instruction_, input=input_)
    )


def reading(question: Column, context: Column) -> Column:
    return tx.fill(fixed.READING_PROMPT, question=question, context=context)


def sentiment(sentence: Column) -> Column:
    return tx.fill(fixed.SENTIMENT_PROMPT, sentence=sentence)


def with_question_words(topics: DataFrame) -> DataFrame:
    """Six rows per topic row, one per question word: an explode of a fixed list, not a join."""
    listed = F.array(*[F.lit(w) for w in fixed.QUESTION_WORDS])
    return topics.select("*", F.posexplode(listed).alias("word_idx", "question_word"))


def all_templates(prompts: DataFrame, prompt: str) -> DataFrame:
    """Each prompt rendered for each known model: rows (.., model, rendered)."""
    options = F.array(
        *[F.struct(F.lit(row[0]).alias("model"), tx.render(row[0])(F.col(prompt)).alias("rendered")) for row in fixed.TEMPLATES]
    )
    return prompts.select("*", F.inline(options))


def extract_by_model(rows: DataFrame, raw: str, model: str = "model") -> Column:
    """The response of each row by its own model's marker rule."""
    choice = None
    for row in fixed.TEMPLATES:
        value = tx.extract(row[0])(F.col(raw))
        choice = F.when(F.col(model) == row[0], value) if choice is None else choice.when(F.col(model) == row[0], value)
    return choice
