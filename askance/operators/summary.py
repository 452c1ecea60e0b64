"""Summaries from a page's own sentences, ranked in a graph of shared words.

Sentences of a page are linked as often as they share distinct words. A sentence's rank flows to its neighbours in
proportion to those links, with a constant part for everyone, for a fixed number of rounds; the best sentences, in
page order, are the summary. Links are never listed: a sentence gives each of its words its share, and takes back
what its words gathered less what it gave itself, so the work of a round is the page's words, not its sentence pairs.

Ranks are whole billionths and every division is a floor, so they are the same on any engine and in any order of
summing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx

UNIT = 1_000_000_000
#: Of a sentence's next rank so many hundredths come from its neighbours.
FLOW_PERCENT = 85
ROUNDS = 10
#: At most one sentence in so many is taken.
ONE_IN = 3


def sentence_ranks(sentence_of: np.ndarray, word: np.ndarray, sentences: int) -> np.ndarray:
    """Ranks in billionths. ``sentence_of`` and ``word`` are parallel: the distinct words of each sentence, by number."""
    holders = np.bincount(word, minlength=1)
    links = np.bincount(sentence_of, weights=holders[word] - 1, minlength=sentences).astype(np.int64)
    own = np.bincount(sentence_of, minlength=sentences)
    rank = np.full(sentences, UNIT, dtype=np.int64)
    constant = UNIT * (100 - FLOW_PERCENT) // 100
    for _ in range(ROUNDS):
        share = np.where(links > 0, rank // np.maximum(links, 1), 0)
        gathered = np.zeros(len(holders), dtype=np.int64)
        np.add.at(gathered, word, share[sentence_of])
        taken = np.zeros(sentences, dtype=np.int64)
        np.add.at(taken, sentence_of, gathered[word])
        rank = constant + FLOW_PERCENT * (taken - own * share) // 100
    return rank


def chosen(ranks: np.ndarray, words: list[int], longest: int) -> list[int]:
    """Places of the sentences to take, ascending: by rank, the earlier on a tie, while their words fit."""
    taken, room = [], longest
    for at in sorted(range(len(words)), key=lambda i: (-int(ranks[i]), i))[: -(-len(words) // ONE_IN)]:
        room -= words[at]
        if room < 0:
            break
        taken.append(at)
    return sorted(taken)


def _summary(sentences: list[str], tokens: pa.ListArray, longest: int) -> str | None:
    if not sentences:
        return None
    coded = tokens.flatten().dictionary_encode()
    sentence_of = np.repeat(np.arange(len(sentences)), np.diff(tokens.offsets.to_numpy()))
    ranks = sentence_ranks(sentence_of, coded.indices.to_numpy(), len(sentences))
    split = [s.split() for s in sentences]
    taken = chosen(ranks, [len(s) for s in split], longest)
    if not taken:  # the best sentence alone is too long
        best = min(range(len(sentences)), key=lambda i: (-int(ranks[i]), i))
        return " ".join(split[best][:longest])
    return " ".join(sentences[i] for i in taken)


def _summaries(pages: pa.StructArray, longest: int) -> pa.Array:
    """Summaries of a batch, a page's sentences as Python strings at a time: a batch holds up to 10,000 pages."""
    out = []
    for page, tokens in zip(pages.field(0), pages.field(1)):
        sentences = page.as_py()
        out.append(_summary(sentences, tokens.values, longest) if sentences else None)
    return pa.array(out, pa.string())


def ranked_summary(text: Column, longest: int = fixed.SUMMARY_MAX_WORDS) -> Column:
    """The summary of a text, 1 to ``longest`` words. NULL or without a sentence: NULL. One sentence: itself. Where the
    best sentence is longer than the limit, its first ``longest`` words."""

    @F.arrow_udf("string")
    def summed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in parts:
            yield _summaries(pages, longest)

    # Bound once: the text may be a long chain of expressions.
    return summed(
        tx.let(
            tx.sentences(text),
            lambda s: F.struct(s.alias("sentences"), F.transform(s, lambda x: F.array_distinct(tx.lexical_tokens(x))).alias("tokens")),
        )
    )
