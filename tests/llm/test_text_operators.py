"""Operators on documents against brute force and the libraries themselves."""

import hashlib
import math
import random
import re
import zlib

import pytest
from conftest_odd import ODD_TEXTS
from pyspark.sql import functions as F

from askance.llm import decontaminate, langid, pieces, pii, simhash, tokenfiles, tokens
from askance.llm.common import fresh_folder


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- SimHash -------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """(doc_id, fingerprint) to component ids, by comparing all distinct fingerprints."""
    values = sorted({f for _, f in fps})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in fps), key=repr)


def test_simhash_is_brute_force(documents, odd):
    docs = documents.select("doc_id", "text").unionByName(
        odd.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    )
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert sorted(rows(simhash.near_duplicates(docs)), key=repr) == plain_components(fps)


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_two_bits_part(spark, seed):
    rng = random.Random(seed)
    values = {0, 1, 3, 7, 15}
    for _ in range(20):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            values.add(v)
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
    for flip in range(0, 1 << 11, 3):  # a posting list with many members
        values.add(0xABCDEF0000000000 ^ flip)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    roots = {a & (2**64 - 1): b & (2**64 - 1) for a, b in rows(simhash.components(simhash.links(frame)))}
    want = {}
    for v, _, c in plain_components([(v if v < 1 << 63 else v - (1 << 64), v) for v in values]):
        want.setdefault(c, set()).add(v & (2**64 - 1))
    got = {}
    for v in values:
        got.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("listed", [1, 3, 40])
def test_long_posting_lists_lose_no_link(spark, listed):
    rng = random.Random(listed)
    values = {0x1122334455667788 ^ rng.getrandbits(12) for _ in range(300)}
    values |= {0x1122334455667788 ^ (rng.getrandbits(9) << 40) for _ in range(200)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    found = rows(simhash.links(frame, listed=listed))
    assert len(found) < 28 * len(signed)  # forests, not pairs
    roots = dict(rows(simhash.components(simhash.links(frame, listed=listed))))
    want = {f: c for f, _, c in plain_components([(s, s % (1 << 64)) for s in signed])}
    assert {s: roots.get(s, s) for s in signed} == want


def test_shared_bytes_are_counted_before_links_are_verified():
    import numpy as np

    base = 0x0102030405060708
    six, five, far = base ^ 0x0100010000000000, base ^ 0x0101010000000000, base ^ 0x0300010000000000
    keys, fps = np.zeros(4, np.int64), np.array([base, six, five, far], dtype=np.int64)
    links = {frozenset(e) for e in simhash._tallied(keys, fps)}
    every = {frozenset((a, b)) for a in (base, six, five, far) for b in (base, six, five, far) if 0 < (a ^ b).bit_count() <= 2}
    assert frozenset((base, far)) not in every and links <= every and len(links) == 3


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:])), "a bigint, b bigint")
    assert {r for _, r in rows(simhash.components(edges))} == {0}


def test_keep_first(odd, empty):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    comps = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd.filter("doc_id is not null")).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(set(comps.values()))
    assert ids.count(None) == 1
    assert simhash.keep_first(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_keep_first_judges_each_row(spark):
    one, two, three, four = ("one fine day in may", "two birds on a wire", "three blind mice ran", "four score and seven")
    table = [
        (None, three), (None, three), (None, four), (None, four + " years ago"),  # copies without an id
        (1, one), (7, one), (7, two), (8, two),  # 7: a copy of 1, and a text of its own that 8 copies
        (9, two), (9, one), (10, "five"), (10, "six"), (10, "six"),
    ]
    kept = simhash.keep_first(spark.createDataFrame(table, "doc_id bigint, text string"))
    want = [(None, three), (None, four), (None, four + " years ago"), (1, one), (7, two), (10, "five"), (10, "six")]
    assert sorted(rows(kept), key=repr) == sorted(want, key=repr)


# ---- decontamination -----------------------------------------------------------------------


def plain_contamination(docs, bench, window=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    wins = [(str(i), w[a : a + window]) for i, t in bench for w in [words(t)] if w for a in range(max(1, len(w) - window + 1))]
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        first = {}
        for a, x in enumerate(w):
            first.setdefault(x, []).append(a)
        for item, win in wins:
            for a in first.get(win[0], ()):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    items.add(item)
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages(spark, sf):
    own = [(1000, "Hello world"), (1001, "b c"), (1002, ""), (1003, None), (None, "a b"), (1004, "Ab ab ab ab ab"), (1000, "hello, WORLD")]
    return spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(
        spark.createDataFrame(own, "item_id bigint, text string")
    )


@pytest.mark.parametrize("size", [200_000, 300])
def test_contamination_is_brute_force(spark, documents, odd, passages, size):
    more = spark.createDataFrame([(-1, "ab " * 9), (-2, "x b c y b c"), (-1, "ab " * 9)], "doc_id bigint, text string")
    docs = documents.select("doc_id", "text").filter("length(text) < 4000").unionByName(odd.select("doc_id", "text").filter("coalesce(length(text), 0) < 1000")).unionByName(more)
    bench = [tuple(r) for r in passages.collect() if r.item_id is not None]
    got = decontaminate.contamination(docs, passages, slice_windows=size).drop("hits")
    assert sorted(rows(got), key=repr) == plain_contamination(rows(docs), bench)


def test_remove_contaminated(odd, empty, passages):
    for size in (200_000, 300):
        bad = {r[0] for r in plain_contamination(rows(odd.select("doc_id", "text").filter("coalesce(length(text), 0) < 1000")), [tuple(r) for r in passages.collect() if r.item_id is not None]) if r[-1]}
        kept = decontaminate.remove_contaminated(odd, passages, slice_windows=size)
        assert kept.columns == odd.columns
        assert bad and {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()} - bad
    assert decontaminate.remove_contaminated(empty, passages).count() == 0
    assert decontaminate.contamination(odd, passages.limit(0)).filter("contaminated").count() == 0


# ---- tokens --------------------------------------------------------------------------------


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_counts_and_cache(spark, documents, odd, empty, tokens_path):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    cache, own = fresh_folder(spark, "cache"), library(tokens_path)
    want = sorted(
        ((d, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for d, t in rows(docs)), key=repr
    )
    half = tokens.token_counts(docs.filter("doc_id % 2 = 0"), cache, tokens_path).count()
    stored = tokens.read_cache(spark, cache).count()
    got = rows(tokens.token_counts(docs, cache, tokens_path))
    assert sorted((r[:3] for r in got), key=repr) == want and all(r[3] == (r[2] > 2048) for r in got)
    after = tokens.read_cache(spark, cache)
    assert half and stored < after.count() == after.select("digest").distinct().count()
    assert tokens.token_counts(docs, cache, tokens_path).count() == len(want)
    assert tokens.read_cache(spark, cache).count() == after.count()
    assert tokens.token_counts(empty, fresh_folder(spark, "cache"), tokens_path).count() == 0


def test_counts_of_another_tokenizer(spark, odd, pieces_path):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    got = tokens.token_counts(odd, fresh_folder(spark, "cache"), pieces_path)
    want = [(r.doc_id, len(own.encode(r.text or ""))) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_token_files(spark, documents, odd, empty, tokens_path):
    docs = documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 50).alias("doc_id"), "text"))
    out, own = fresh_folder(spark, "files"), library(tokens_path)
    manifest = tokenfiles.write_token_files(docs, out, tokens_path, parts=5)
    got = sorted(rows(tokenfiles.read_token_files(spark, out, manifest)), key=lambda r: r[1])
    import struct

    at, want = 0, {}
    for d, t in rows(docs):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    keys = [r[0] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    for d, start, n, crc in got:
        assert start == at
        want[d].remove((n, crc))
        at += n
    assert not any(want.values())
    nothing = fresh_folder(spark, "files")
    assert tokenfiles.read_token_files(spark, nothing, tokenfiles.write_token_files(empty, nothing, tokens_path)).count() == 0


# ---- pieces --------------------------------------------------------------------------------


def test_pieces_are_lossless_and_repeatable(documents, odd, empty, pieces_path):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = pieces.sampled_digests(docs, pieces_path)
    first = sorted(rows(got), key=repr)
    assert all(r[-1] for r in first) and len(first) == docs.count()
    again = pieces.sampled_digests(docs.repartition(7, "text"), pieces_path)
    assert sorted(rows(again), key=repr) == first
    other = pieces.sampled_digests(docs, pieces_path, seed=7)
    assert sorted(rows(other), key=repr) != first
    assert pieces.sampled_digests(empty, pieces_path).count() == 0
    wide = pieces.with_pieces(odd, pieces_path, column="key")
    assert wide.columns == [c for c in odd.columns if c != "key"] + ["key"] and wide.count() == odd.count()
    back = odd.select("text", pieces.sampled(F.col("doc_id"), F.col("text"), pieces_path).alias("ids")).select(
        "text", pieces.decoded(F.col("ids"), pieces_path).alias("back")
    )
    assert all(r.back == (r.text or "") for r in back.collect())


def test_draws_follow_the_weights(pieces_path):
    """The shares of sampled segmentations against all segmentations of a word, spelt out."""
    own = pieces.Lattice(pieces_path)
    word = " thence"

    def every(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in own.weight:
                i, w = own.weight[rest[:n]]
                for ids, more in every(rest[n:]):
                    yield (i, *ids), w * more

    weights = dict(every(word))
    total, n = sum(weights.values()), 40_000
    bounds, ids = own.sample([word] * n, [k * 7919 for k in range(n)])
    seen = {}
    for a, b in zip(bounds[:-1], bounds[1:]):
        k = tuple(ids[a:b].tolist())
        seen[k] = seen.get(k, 0) + 1
    assert set(seen) <= set(weights)
    for k, w in weights.items():
        p = w / total
        assert abs(seen.get(k, 0) - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 1


def test_long_units_and_matrix_agree(pieces_path):
    own, other = pieces.Lattice(pieces_path), pieces.Lattice(pieces_path)
    for unit in (" international", "ééé", "a" * 40, " 中😀x"):
        own.learn([unit])
        other._learn_long(unit)
        a, b = own.units[unit], other.units[unit]
        ends = [(x.first.rows()[x.start.rows()[n] :][: len(unit)]) for x, n in ((own, a), (other, b))]
        for x, first in ((own, ends[0]), (other, ends[1])):
            assert (x.share.rows()[first] > 0).all()
        shares = [sorted(zip(x.piece.rows()[f[-1] :].tolist(), x.back.rows()[f[-1] :].tolist())) for x, f in ((own, ends[0]), (other, ends[1]))]
        assert shares[0] == shares[1]


# ---- language ------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for _, r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(lang == r.lang_pred for lang, r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got.values()) <= 0.02 * len(got)


def test_language_is_plain_compression(spark, documents):
    import zstandard

    words = "der schnelle braune Fuchs springt über 3 faule Hunde; the quick fox — le renard brun, el zorro rápido. "
    texts = ["a", "Ü" * 4_001, words, words * 900, "1 2 3 x", "été\n" * 2_000 + "END", "und " * 1_000]
    docs = documents.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(10**9 + n, t, None) for n, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    )
    made = langid.learn(docs.filter(langid.fold() != 1))
    text = {r.doc_id: r.text for r in docs.collect()}
    lengths = set()
    for r in langid.identify(docs).collect():
        if r.lang_pred == "und":
            continue
        folded = "".join(c if c in "abcdefghijklmnopqrstuvwxyz'" or ord(c) > 127 else " " for c in text[r.doc_id].lower())
        data = b" ".join(folded.encode().split())
        lengths.add(len(data) > 4_000)
        sizes = {}
        for lang, words in made.items():
            sizes[lang] = 0
            for at in range(0, len(data), 4_000):
                packer = zstandard.ZstdCompressor(
                    level=6, write_content_size=False, write_dict_id=False,
                    dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                )
                sizes[lang] += len(packer.compress(words[-2_000:] + b" " + data[at : at + 4_000]))
        ranked = sorted(sizes, key=lambda x: (sizes[x], x))
        margin = sizes[ranked[1]] / sizes[ranked[0]] - 1
        assert r.lang_pred == ranked[0], (r.doc_id, sizes)
        assert abs(r.margin - margin) < 1e-12 and r.rejected == (margin < langid.MIN_MARGIN)
        score = 1 / sum(math.exp((sizes[ranked[0]] - s) / 2) for s in sizes.values())
        assert abs(r.score - score) < 1e-9
    assert lengths == {True, False}


def test_language_odd_rows(odd, documents, empty):
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    both = documents.unionByName(odd.select(*documents.columns))
    judged = langid.identify(both).collect()
    silent = {n for n, t in enumerate(ODD_TEXTS) if not t or not any(map(str.isalpha, t))}
    assert len(judged) == both.count() and all(0 <= r.score <= 1 for r in judged)
    blank = [r for r in judged if r.lang_pred == "und"]
    assert len(blank) == len(silent) and all(r.rejected and r.score == 0 for r in blank)
    assert langid.keep_identified(both).count() == sum(not r.rejected for r in judged)


# ---- personal data -------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))]
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) < 256 for x in m.group().split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and sum(double) % 10 == 0)
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out))


PRIVATE = [
    "a@b.c_d@e.fg a@@b.co x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 1.2.3", "+4111111111111111 é@x.y q@w.e.r.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111", "+1 (555) 010-2030. +49 30 1234567890123456 +1",
    "😀 a.b@c.de 😀 +12345678901", "9" * 20_000, "a" * 20_000 + "@", "-5.6.7.8.9@x.y..z", "4111111111111111 5500-0000-0000-0004",
]


def test_base_spans_are_brute_force(spark, documents, odd, empty):
    more = spark.createDataFrame([(10_000 + n, t) for n, t in enumerate(PRIVATE)], "doc_id bigint, text string")
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    got = sorted(((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.personal_data(docs).collect()), key=repr)
    want = []
    for d, t in rows(docs):
        spans = plain_spans(t)
        want.append((d, hashlib.sha256(spans.encode()).hexdigest(), spans.count(":") // 2))
    assert got == sorted(want, key=repr)
    assert pii.personal_data(empty).count() == 0


def test_contexts_find_what_no_base_pattern_covers(spark):
    texts = [f"please call us at +1 (20{n}) 555-01{n}7 today" for n in range(9)]
    texts += ["please call us at 555-0142 today", "the year 1984 was long", "please call us at +1 (202) 555-0199 today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[9].spans == "phone:18:26" and got[9].n_phone == 0
    assert got[10].spans == "" and got[0].spans == "phone:18:35"
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[9] == "please call us at [PHONE] today" and masked[10] == texts[10]


def test_mask_keeps_rows_and_columns(odd, empty):
    done = pii.mask(odd)
    assert done.columns == odd.columns and done.count() == odd.count()
    plain = {r.doc_id: r.text for r in odd.collect() if not plain_spans(r.text)}
    assert all(r.text == plain[r.doc_id] for r in done.collect() if r.doc_id in plain)
    assert pii.mask(empty).count() == 0
