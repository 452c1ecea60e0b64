"""Registered queries, each with its check SQL where plain SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


# ---- SQL pieces for the checks ------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_strip(x: str) -> str:
    return f"trim({x}, {lit(fixed.WHITE_SPACE)})"


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit('[' + fixed.WHITE_SPACE + ']+')}), lambda w: w <> '')"


def s_sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {s_strip('s')}), lambda s: s <> '')"
    )


def s_trigrams(x: str) -> str:
    return (
        f"list_distinct(list_transform(generate_series(1, length({x}) - 2), "
        f"lambda i: substr(lower({x}), i, 3)))"
    )


def s_fill(template: str, **parts: str) -> str:
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(lit(p) if i % 2 == 0 else parts[p] for i, p in enumerate(pieces) if i % 2 or p)


def s_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


NAN = "'NaN'::DOUBLE"

QUESTIONS = (
    "q AS (SELECT conv_id * 4294967296 + turn AS q_id, conv_id, turn, text AS prompt "
    "FROM conversations WHERE role = 'user')"
)
PAIRS = (
    "qa AS (SELECT conv_id * 4294967296 + turn AS q_id, conv_id, turn, text AS prompt, next_text AS passage FROM ("
    "SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
)
# The check goes pair by pair, where the query counts trigram holders.
SCORES = (
    f"{PAIRS}, sent AS (SELECT q_id, conv_id, turn, unnest({s_sentences('passage')}) AS sentence, "
    f"generate_subscripts({s_sentences('passage')}, 1) - 1 AS sent_idx FROM qa), "
    f"st AS (SELECT *, {s_trigrams('sentence')} AS tri FROM sent), "
    f"smp AS (SELECT conv_id, turn, {s_trigrams('text')} AS tri FROM conversations WHERE role = 'assistant'), "
    "pr AS (SELECT st.q_id, st.sent_idx, len(st.tri) AS n_tri, smp.turn AS sample, "
    "len(list_intersect(st.tri, smp.tri)) AS hits FROM st "
    "LEFT JOIN smp ON smp.conv_id = st.conv_id AND smp.turn <> st.turn + 1), "
    "ss AS (SELECT q_id, sent_idx, any_value(n_tri) AS n_tri, count(sample) AS n_samples, "
    "coalesce(sum(hits), 0)::BIGINT AS hits, "
    f"coalesce(avg(CASE WHEN sample IS NOT NULL AND n_tri > 0 THEN 1 - hits::DOUBLE / n_tri END), {NAN}) AS score "
    "FROM pr GROUP BY 1, 2), "
    f"ps AS (SELECT qa.q_id, count(ss.sent_idx) AS n_sentences, "
    f"coalesce(avg(CASE WHEN NOT isnan(ss.score) THEN ss.score END), {NAN}) AS average_score "
    "FROM qa LEFT JOIN ss ON ss.q_id = qa.q_id GROUP BY 1), "
    "sc AS (SELECT qa.*, ps.n_sentences, ps.average_score, "
    "(NOT isnan(ps.average_score) AND ps.average_score > 0.5) AS hallucinated FROM qa JOIN ps USING (q_id))"
)
