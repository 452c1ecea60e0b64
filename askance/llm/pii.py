"""Personal data: base patterns, and contexts learned from them that find more. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns with their checks. They are the seed
entities. Every identifier-like token (the seeds, and others with a digit or an address sign) is a
candidate; the words around it make lexical patterns. Patterns and distinct values form a graph, scored in
rounds: a pattern's confidence is the weight of its values of one kind against that of other kinds and half
of the unknown ones; a value's is 1 - prod(1 - confidence) over its trusted patterns, and counts in the
next round. Patterns that are trusted in the end, by at least ``LEAST_SUPPORT`` different values, mark
candidates that no base span touches and no check has refuted.

Edges are distinct (pattern, value) pairs, so a passage that a third of all documents quote is one edge,
and a pattern as common as "the _" is sums over its edges, made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# Possessive loops read long runs without going back, which finds the same matches; a match can only begin
# where a run of its first characters begins, or where the last match ended.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))" + _EMAIL,
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": _PHONE,
}
_WORD = "A-Za-z0-9_.@%+-"
CANDIDATE = (
    rf"{_PHONE}|(?:\G|(?<![A-Za-z0-9._%+-])){_EMAIL}|(?:\G|(?<![{_WORD}]))"
    rf"(?:[0-9](?:[\x20-]?+[0-9])++(?![{_WORD}])|[A-Za-z_.@%+-]*+[0-9][{_WORD}]*+)"
)
#: Shortest candidate that can be found; shorter numbers are everywhere.
LEAST_LENGTH = 4
ROUNDS = 3
LEAST_SUPPORT = 3
PATTERN_CONFIDENCE = 0.7
FOUND_CONFIDENCE = 0.85
UNKNOWN_WEIGHT = 0.5
_CONTEXT_CHARS = 80

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_NONE = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before, after): matches with the pieces of text around them."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.aggregate(
        F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), F.zip_with(
            values, F.slice(pieces, F.lit(2), F.size(values)), lambda v, p: F.struct(v.alias("value"), p.alias("after"))
        ), lambda p, m: F.struct(p.alias("before"), m["value"].alias("value"), m["after"].alias("after"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["before"]) + F.length(m["value"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + F.length(m["before"])).alias("start"),
                    (acc["at"] + F.length(m["before"]) + F.length(m["value"])).alias("end"),
                    m["value"].alias("value"),
                    F.right(m["before"], F.lit(_CONTEXT_CHARS)).alias("before"),
                    F.left(m["after"], F.lit(_CONTEXT_CHARS)).alias("after"),
                ),
            ).alias("out"),
        ),
    )
    return F.when(F.size(values) > 0, made["out"]).otherwise(F.array().cast(_NONE))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.reverse(F.split(_digits(value), "")), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    total = F.aggregate(
        F.transform(
            digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
        ),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    return F.when(n.between(12, 19), _luhn(value)).otherwise(False) if kind == "card" else n.between(9, 15)


_MAY_HOLD = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text: Column) -> Column:
    """The base spans of a text by start, then kind: array of (start, kind, end) in code points.

    ``kind`` is the place in ``KINDS``, ``end`` exclusive. Null has none.
    """
    text, parts = F.coalesce(text, F.lit("")), []
    for k, kind in enumerate(KINDS):
        found = F.transform(
            F.filter(_matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"])),
            lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")),
        )
        may = text.contains(_MAY_HOLD[kind]) if kind in ("email", "phone") else text.rlike("[0-9]")
        parts.append(F.when(may, found).otherwise(F.array().cast(_SPANS)))
    return F.array_sort(F.concat(*parts))


def _candidates(text: Column, base: Column) -> Column:
    """Candidates with the kind of the base span they are (else null) and their lexical patterns."""
    text = F.coalesce(text, F.lit(""))
    found = F.when(text.rlike("[0-9@]"), _matches(text, CANDIDATE)).otherwise(F.array().cast(_NONE))

    def described(m: Column) -> Column:
        value = F.regexp_replace(m["value"], "[._%+@-]+$", "")
        end = m["end"] - F.length(m["value"]) + F.length(value)
        left = F.regexp_replace(F.lower(m["before"]), r"[0-9]+", "0")
        left = F.filter(F.split(left, r"\s+"), lambda w: w != "")
        right = F.filter(F.split(F.regexp_replace(F.lower(m["after"]), r"[0-9]+", "0"), r"\s+"), lambda w: w != "")
        one = F.coalesce(F.get(F.reverse(left), F.lit(0)), F.lit("^"))
        two = F.coalesce(F.get(F.reverse(left), F.lit(1)), F.lit("^"))
        after = F.coalesce(F.get(right, F.lit(0)), F.lit("$"))
        shape = F.regexp_replace(F.regexp_replace(F.lower(value), r"\p{L}+", "a"), "[0-9]+", "0")
        is_kind = F.get(
            F.filter(base, lambda b: (b["start"] == m["start"]) & (b["end"] == end)), F.lit(0)
        )["kind"]
        # A whole match whose check failed is refuted as what it looks like; no context makes it one again.
        refuted = value.rlike(r"^[0-9](?:[\x20-]?[0-9]){11,18}$") | value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
        touched = F.exists(base, lambda b: (b["start"] < end) & (b["end"] > m["start"]))
        return F.struct(
            m["start"].alias("start"),
            end.alias("end"),
            F.xxhash64(F.lower(value)).alias("value"),
            is_kind.alias("kind"),
            touched.alias("touched"),
            refuted.alias("refuted"),
            F.array(
                F.xxhash64(F.lit("two"), two, one),
                F.xxhash64(F.lit("around"), one, after),
                F.xxhash64(F.lit("shape"), one, shape),
            ).alias("patterns"),
        )

    return F.filter(
        F.transform(found, described),
        lambda c: ((c["end"] - c["start"]) >= LEAST_LENGTH) & (c["kind"].isNotNull() | ~c["touched"]),
    )


def _scored(edges: DataFrame, rounds: int) -> DataFrame:
    """(pattern, kind, confidence) of the trusted patterns, after ``rounds`` over the graph."""
    values = cut_lineage(edges.groupBy("value").agg(F.max("kind").alias("kind")).withColumn("weight", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)))
    links = edges.select("pattern", "value")
    trusted = None
    for n in range(rounds):
        met = links.join(values, "value")
        sums = [F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(f"w{k}") for k in range(len(KINDS))]
        support = [F.sum(F.when((F.col("kind") == k) & (F.col("weight") > 0), 1).otherwise(0)).alias(f"n{k}") for k in range(len(KINDS))]
        best = F.array_max(F.array(*[F.struct(F.col(f"w{k}").alias("w"), F.col(f"n{k}").alias("n"), F.lit(k).alias("kind")) for k in range(len(KINDS))]))
        known = sum((F.col(f"w{k}") for k in range(1, len(KINDS))), F.col("w0"))
        judged = met.groupBy("pattern").agg(F.count("*").alias("of"), *sums, *support).withColumn("best", best)
        confidence = F.col("best.w") / (known + UNKNOWN_WEIGHT * (F.col("of") - known))
        trusted = cut_lineage(
            judged.filter(F.col("best.n") >= LEAST_SUPPORT)
            .select("pattern", F.col("best.kind").alias("kind"), F.least(confidence, F.lit(0.999)).alias("confidence"))
            .filter(F.col("confidence") >= PATTERN_CONFIDENCE)
        )
        if n + 1 == rounds:
            return trusted
        raised = (
            links.join(trusted, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("weight"))
            .groupBy("value")
            .agg(F.max(F.struct("weight", "kind")).alias("raised"))
        )
        values = cut_lineage(
            values.join(raised, "value", "left").select(
                "value",
                F.when(F.col("weight") >= 1.0, F.col("kind")).otherwise(F.col("raised.kind")).alias("kind"),
                F.when(F.col("weight") >= 1.0, F.lit(1.0)).otherwise(F.coalesce("raised.weight", F.lit(0.0))).alias("weight"),
            )
        )
    return trusted


def _spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def discover(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, base) per row, and (key, extra) for rows where contexts found more.

    ``key`` is a hash of doc_id and text; rows that repeat both share it and have equal results.
    """
    base = docs.select("doc_id", _key().alias("key"), F.col("text"), base_spans(F.col("text")).alias("base"))
    found = cut_lineage(base.select("doc_id", "key", "base", _candidates(F.col("text"), F.col("base")).alias("candidates")))
    one = found.select("key", F.explode("candidates").alias("c")).select("key", "c.*")
    edges = cut_lineage(
        one.select(F.explode("patterns").alias("pattern"), "value", "kind")
        .groupBy("pattern", "value")
        .agg(F.max("kind").alias("kind"))
    )
    trusted = _scored(edges, rounds)
    open_ = one.filter("kind is null and not refuted").select("key", "start", "end", F.explode("patterns").alias("pattern"))
    extra = (
        open_.distinct()
        .join(trusted, "pattern")
        .groupBy("key", "start", "end", "kind")
        .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("sure"))
        .groupBy("key", "start", "end")
        .agg(F.max(F.struct("sure", "kind")).alias("best"))
        .filter(F.col("best.sure") >= FOUND_CONFIDENCE)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", F.col("best.kind").alias("kind"), "end"))).alias("extra"))
    )
    return found.select("key", "doc_id", "base"), cut_lineage(extra)


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs`` (doc_id, text).

    Counts and digest are of the base spans; ``spans`` holds these and what the contexts found, as
    kind:start:end by start, then kind as listed, in code points, end exclusive. Null and empty texts have
    none. Repeated rows come out as often as they came in; extra columns are not looked at.
    """
    found, extra = discover(docs, rounds)
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPANS))))
    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS)
    ]
    return found.join(extra, "key", "left").select(
        "doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(every).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap are one, named by the first."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(kinds, s["kind"])))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with all spans of ``text`` masked; every row and every other column stays, null texts too."""
    _, extra = discover(docs, rounds)
    key, more = _spare(docs, "pii_key"), _spare(docs, "pii_extra")
    extra = extra.select(F.col("key").alias(key), F.col("extra").alias(more))
    every = F.array_sort(F.concat(base_spans(F.col("text")), F.coalesce(F.col(more), F.array().cast(_SPANS))))
    names = [F.col(f"`{c}`") if c != "text" else masked(F.col("text"), F.col(more)).alias("text") for c in docs.columns]
    return docs.withColumn(key, _key()).join(extra, key, "left").withColumn(more, every).select(names)
