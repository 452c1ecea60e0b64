"""Text as Column expressions: stripping, words, sentences, n-grams, templates, verdicts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# the same set as a pattern: Unicode white space and the four separators; a listed class is slower
_WS_RUN = r"(?U)[\s\x1c-\x1f]+"
_MARK = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``.

    A lambda body is evaluated per element, so an outer expression used inside one
    would be recomputed each time; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Python's ``str.strip()``."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def words(text: Column) -> Column:
    """Python's ``str.split()``."""
    return F.array_remove(F.split(text, _WS_RUN), "")


def fill(template: str, **parts: Column) -> Column:
    """The template with each ``{name}`` replaced by a column."""
    pieces = re.split(r"\{(\w+)\}", template)
    columns = [F.lit(piece) if i % 2 == 0 else parts[piece] for i, piece in enumerate(pieces)]
    return F.concat(*columns)


def sentences(text: Column) -> Column:
    """Stripped sentences; a sentence ends at ``.``, ``!`` or ``?`` followed by white space."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\x0B\f\r]+", "$1" + _MARK)
    return F.filter(F.transform(F.split(marked, _MARK), strip), lambda s: s != "")


def trigrams(text: Column) -> Column:
    """Distinct lower-case character trigrams, empty for texts under three characters."""
    # one match per character; the second half of a two-unit character is no place to start
    windows = F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(...))")
    return F.array_distinct(F.regexp_extract_all(F.lower(text), windows, F.lit(1)))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, in order."""
    if n == 1:
        return tokens
    return let(
        tokens,
        lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))),
                lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]),
            )
        ),
    )


def cut_words(text: Column, n: int, compat: bool = False) -> Column:
    """The text up to its n-th single blank; ``compat`` also loses the last character of
    texts with fewer blanks, as a search that returns -1 does."""
    whole = F.substring_index(text, " ", n)
    if not compat:
        return whole
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(blanks >= n, whole).otherwise(_all_but_last(text))


def _all_but_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))


def remove_tokens(text: Column, tokens: list[str]) -> Column:
    """Remove literal tokens one after another (a later token may appear once an earlier one goes)."""
    for token in tokens:
        text = F.replace(text, F.lit(token), F.lit(""))
    return text


def clean(value: Column) -> Column:
    """Text form with NULL as the missing mark, stripped."""
    return strip(F.coalesce(value.cast("string"), F.lit(fixed.MISSING_TEXT)))


# ---- chat templates ---------------------------------------------------------------------


def template_of(model: str) -> tuple:
    for row in fixed.TEMPLATES:
        if row[0] == model:
            return row
    raise ValueError(f"no chat template for {model!r}")


def tidy(prompt: Column) -> Column:
    one = F.replace(strip(prompt), F.lit("\r\n"), F.lit("\n"))
    return F.replace(one, F.lit("\n\n"), F.lit("\n"))


def render(model: str) -> Callable[[Column], Column]:
    """The prompt function of a model: Column to Column."""
    _, prefix, suffix, _, _, tidied = template_of(model)
    return lambda prompt: F.concat(F.lit(prefix), tidy(prompt) if tidied else prompt, F.lit(suffix))


def extract(model: str) -> Callable[[Column], Column]:
    """The response function of a model: the text after the last marker, or all of it."""
    _, _, _, marker, stripped, _ = template_of(model)

    def after(raw: Column) -> Column:
        out = F.substring_index(raw, marker, -1) if marker else raw
        return strip(out) if stripped else out

    return after


# ---- verdicts ---------------------------------------------------------------------------


def verdict_class(raw: Column) -> Column:
    text = strip(F.lower(raw))
    return (
        F.when(text.startswith("yes"), "yes")
        .when(text.startswith("no"), "no")
        .when(text.startswith("partly"), "partly")
        .otherwise("other")
    )


def verdict_score(raw: Column) -> Column:
    kind = verdict_class(raw)
    return (
        F.when(kind == "yes", F.lit(1.0))
        .when(kind == "no", F.lit(0.0))
        .when(kind == "partly", F.lit(0.5))
        .otherwise(F.lit(fixed.UNKNOWN_VERDICT))
    )


def hallucinated(score: Column) -> Column:
    """Strictly above the threshold; NaN and NULL count as not hallucinated."""
    return F.coalesce(~F.isnan(score) & (score > fixed.HALLUCINATION_THRESHOLD), F.lit(False))


# ---- pages ------------------------------------------------------------------------------

# scripts and styles go first: their text may hold what looks like tags
_BOILERPLATE = ["script|style", "head|nav|footer|aside|form|noscript"]
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """Readable text of a page: boilerplate blocks, comments and tags out, block ends as line
    breaks, entities decoded, blank runs folded; the missing mark when nothing is left."""
    text = html
    for tags in _BOILERPLATE:
        text = F.regexp_replace(text, rf"(?is)<({tags})(\s[^>]*)?>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|article|section)(\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = strip(F.regexp_replace(text, r" ?\n[ \n]*", "\n"))
    return F.when(text == "", fixed.MISSING_TEXT).otherwise(text)


# ---- metric tokenisers ------------------------------------------------------------------


def bleu_tokens(text: Column) -> Column:
    out = F.replace(text, F.lit("<skipped>"), F.lit(""))
    out = F.replace(out, F.lit("-\n"), F.lit(""))
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    for entity, char in [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, to in fixed.BLEU_TOKEN_RULES:
        out = F.regexp_replace(out, pattern, to)
    return words(out)


def rouge_tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def answer_tokens(text: Column) -> Column:
    """Tokens of a short answer: lower case, punctuation and articles out."""
    out = F.regexp_replace(F.lower(text), fixed.PUNCTUATION_CLASS, "")
    return words(F.regexp_replace(out, fixed.ARTICLES_PATTERN, " "))


def lexical_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def token_id(token: Column) -> Column:
    """A stable token number in 1..2^60, the default where no tokeniser is plugged in."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint") + 1
