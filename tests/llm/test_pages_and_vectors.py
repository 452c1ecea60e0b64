"""Page extraction, archives, vector search and the pipeline against brute force."""

import base64
import hashlib
import html
import io
import math
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from askance.llm import ann, extract, warc
from askance.llm.common import fresh_folder

PAGES = "page_id bigint, url string, html string, text int, key string"


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def plain_article(source):
    body = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"</?[a-z0-9]+>", " " if "br" in b else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_articles_are_brute_force(pages):
    got = {r.page_id: r for r in extract.main_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain_article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def site(n, own):
    """Pages that mark no article: a menu without a telling name, and text of their own."""
    return (
        f"<body><div class=top><a href='/a'>Home</a> <a href='/b'>All items</a></div><div class=box>{own}</div>"
        f"<div class=low>Made by us, always the same words</div></body>"
    )


def test_tree_removes_what_all_pages_share(spark):
    rows = [(n, f"https://one.example/{n}", site(n, f"<p>Own text {n * 37}.<p>More of it: {n * n}.")) for n in range(30)]
    rows += [(100 + n, f"https://two.example/{n}", f"<article class=x><div class='lead y'>Same lead</div><p>Quoted by all</p><p>Own {n}</p></article>") for n in range(20)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract.main_text(frame).collect()}
    assert got[3] == "Own text 111.\nMore of it: 9."
    assert got[104] == "Quoted by all\nOwn 4"
    tree = extract.style_tree(frame)
    top = [r for r in tree.collect() if r.pages == 30]
    for r in top:
        assert 0 <= r.importance <= 1 and r.styles >= 1
    shared = [r for r in top if r.content < 1e-9]
    own = [r for r in top if r.content > 0.99]
    assert shared and own


WRAPPERS = [
    ("<body class='has-sidebar'>{}</body>", True),
    ("<body><div id='page' class='site header-fixed'>{}</div></body>", True),
    ("<body><div class='content-with-sidebar'>{}</div></body>", True),
    ("<body><main class='has-menu'>{}</main></body>", True),
    ("<article class='post comments-open'>{}</article>", False),
    ("<div class='with-sidebar'><article>{}</article></div>", False),
    ("<div class='with-sidebar'><main class='share'>{}</main><div class='widget'>W</div></div>", False),
]


def test_names_of_wrappers_keep_their_text(spark):
    rows, want = [], {}
    for k, (wrapper, menu) in enumerate(WRAPPERS):
        for n in range(20):
            own = f"<h2 id='social-history'>Head {n}</h2><section id='related-work'><p>Own {n * 37}.</p></section><p>Not <b id='ad-{n}'>so {n}</b>.</p>"
            top = "<div class='menu'>Home <a href='/b'>Items</a></div>" if menu else ""
            rows.append((100 * k + n, f"https://h{k}.example/{n}", wrapper.format(top + own)))
            want[100 * k + n] = f"Head {n}\nOwn {n * 37}.\nNot so {n}."
    rows.append((9000, "https://one.example/", "<div class='top-banner'><article class='ad'>A</article></div><div class='sidebar'>s</div>"))
    want[9000] = "A"
    got = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_names_only_lower_importance(spark):
    """Five adverts dealt over 200 pages are kept without a telling name, and removed with one."""
    rows = [
        (n, f"https://{name}.example/{n}", f"<div class='{name}'>Buy {n % 5}</div><div class=x><p>Own {n}</p></div>")
        for name in ("advert", "other")
        for n in range(200)
    ]
    got = {r.url: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got["https://advert.example/7"] == "Own 7"
    assert got["https://other.example/7"] == "Buy 2\nOwn 7"


#: Noise named as a whole, with text of its own on each page.
NAMED = [
    "<div class='advert'>{}</div>", "<div class='ad-3'><p>{}</p></div>", "<section id='comments'><p>{}</p></section>",
    "<div class='comments-area'><article><p>{}</p></article></div>", "<div class='sidebar'><ul><li>{}</li></ul></div>",
    "<div class='cookie-notice'>{}</div>", "<ul class='Related share'><li>{}</li></ul>",
]


def test_whole_names_remove_what_has_text_of_its_own(spark):
    """In an article, beside one, on pages without one, and on a host of one page; names in part keep theirs."""
    body, rows = "<h1>Title {}</h1><p>Body of {}.</p><div class='related-work'>Work {}.</div>", []
    for k, noise in enumerate(NAMED):
        for n in range(4):
            own, other = body.format(n, n, n), noise.format(f"noise {n} of {k}")
            rows += [
                (1000 * k + 10 * n, f"https://a{k}.example/{n}", f"<body><article>{own}{other}</article></body>"),
                (1000 * k + 10 * n + 1, f"https://b{k}.example/{n}", f"<body><main>{own}</main>{other}</body>"),
                (1000 * k + 10 * n + 2, f"https://c{k}.example/{n}", f"<body><div id='page'>{other}{own}</div></body>"),
                (1000 * k + 10 * n + 3, f"https://d{k}-{n}.example/", f"<div class='nav'>N {n}</div>{own}{other}<div class='footer'>F</div>"),
            ]
    got = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "Title {0}\nBody of {0}.\nWork {0}.".format(i % 1000 // 10) for i, _, _ in rows}


def test_whole_names_spare_titles_and_most_of_the_text(spark):
    rows = [
        (1, "https://a.example/", "<div class='header'><h1>T</h1></div><div class='widget'><p>Most of the text</p></div>"),
        (2, "https://b.example/", "<div class='content'><h1>T</h1><p>x</p></div><div class='comments'><p>Many long remarks</p></div>"),
        (3, "https://c.example/", "<div class='comments'><p>Only remarks</p></div>"),
        (4, "https://d.example/", "<div class='ad'>a b</div><div class='promo'>c d</div>"),
        (5, "https://e.example/", "<article><h2 class='social'>S</h2><p>See <b class='share'>b</b></p></article>"),
    ]
    got = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "T\nMost of the text", 2: "T\nx", 3: "Only remarks", 4: "a b\nc d", 5: "S\nSee b"}


def test_no_depth_is_left_out(spark):
    """Menus and text far down are elements of their own, and contents add up over all levels."""
    rows = [
        (100 * deep + n, f"https://d{deep}.example/{n}", "<div>" * deep + site(n, f"<p>Own {n * 37}.")[6:-7] + "</div>" * deep)
        for deep in (15, 17, 40)
        for n in range(30)
    ]
    rows += [(9000 + n, "https://z.example/", "".join(f"<div class=c{i}>T{i * n}" for i in range(70))) for n in range(3)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract.main_text(frame).collect()}
    assert all(got[100 * deep + n] == f"Own {n * 37}." for deep in (15, 17, 40) for n in range(30))
    seen, over, pages = {}, {}, {}
    for _, url, source in rows:
        page = extract.Page(source)
        element, _ = page.keys(extract.host_of(url))
        for n in range(1, len(element)):
            over[element[n]] = {element[a] for a in page._line(n) if a}
        for e in set(element[1:]):
            pages[e] = pages.get(e, 0) + 1
        for at in {(element[n], text) for n, text in [*page.texts(), *page.links] if n}:
            seen[at] = seen.get(at, 0) + 1
    logs = {}
    for (e, _), count in seen.items():
        for a in over[e]:
            logs.setdefault(a, []).append(math.log(count))
    tree = {r.element: r for r in extract.style_tree(frame).collect()}
    assert set(tree) == set(over)
    for e, r in tree.items():
        want = 1.0 if pages[e] < 2 else max(0.0, 1 - sum(logs[e]) / len(logs[e]) / math.log(pages[e])) if e in logs else 0.0
        assert r.pages == pages[e] and math.isclose(r.content, want, abs_tol=1e-9)


ODD_PAGES = [
    (1, "https://h.example/", None, ""),
    (2, None, "", ""),
    (3, "no host", "<p>a &amp; b&nbsp;c <b>d</b><br>e", "a & b c d e"),
    (4, "x://y", "<article><nav>n</nav><h1>T</h1><p>a<p>b<aside>s</aside><form>f<input></form><script>var x='</p>'</script><p>&#233;&copy x</article><footer>z", "T\na\nb\né© x"),
    (5, "x://y", "plain <!-- c > --> text < 3 & <unclosed", "plain text < 3 &"),
    (6, "x://y", "<main><header><h1>T</h1></header><article>A</article><section class='comments'><article>c</article></section></main>", "A"),
    (7, "x://y", "<div hidden>h</div><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1\n2\n3"),
    (8, "x://y", "<p>" + "w " * 100_000, ("w " * 100_000).strip()),
    (9, "x://y", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    (10, "x://y", "<title>t</title><style>p{}</style><p style='display:none'>n</p><p title='a > b'>q</p>", "q"),
    (None, "x://y", "<p>no id", "no id"),
]


def test_odd_pages(spark):
    frame = spark.createDataFrame([(i, u, h, 1, "k") for i, u, h, _ in ODD_PAGES] * 2, PAGES)
    got = extract.main_text(frame).collect()
    want = {i: t for i, _, _, t in ODD_PAGES}
    assert len(got) == 2 * len(ODD_PAGES)
    for r in got:
        assert r.text == want[r.page_id], r.page_id
    assert extract.main_text(frame.limit(0)).count() == 0


# ---- archives ------------------------------------------------------------------------------


def test_archive_round_trip(spark, pages):
    first = pages.first()
    rows = [(10_000, "u", None), (10_001, "a b\r\nX: y", ""), (None, None, "<p>x"), (10_002, "u", "é😀" * 50_000)]
    rows += [(20_000 + n, "https://c/", first.html) for n in range(5)] + [(20_000, "https://c/", first.html)]
    own = pages.unionByName(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    wide = own.withColumn("path", F.lit("p")).withColumn("refers_to", F.lit("r")).withColumn("size", F.lit(1))
    source = [(r.page_id, (r.html or "").encode()) for r in own.collect()]
    last = {}
    for i, body in source:
        if i is not None:
            last[body] = max(last.get(body, i), i)
    want = []
    for i, body in source:
        to = last[body] if i is not None and last[body] != i else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((i, len(body), digest, "response" if to is None else "revisit", to))
    folder = fresh_folder(spark, "warc")
    packages = warc.write_packages(wide, folder, package_bytes=20_000)
    assert packages.count() > 3
    got = warc.read_packages(spark, packages, payloads=True).collect()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.html.encode() for r in got if r.record_type == "response"} == {b for _, b in source}
    assert warc.archived(own.limit(0)).count() == 0


def test_each_payload_of_a_page_is_decided(spark):
    rows = [(1, "u", "A"), (1, "u", "B"), (1, "u", "B"), (2, "u", "A"), (3, "u", "C"), (3, "u", "D"), (4, "u", "C"), (5, "u", "D"), (5, "u", "E")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    packages = warc.write_packages(pages, fresh_folder(spark, "warc"))
    names = {warc.digest_of(b.encode()): b for b in "ABCDE"}
    got = [(r.page_id, names[r.payload_digest], r.refers_to, r.html) for r in warc.read_packages(spark, packages, payloads=True).collect()]
    to = {(1, "A"): 2, (3, "C"): 4, (3, "D"): 5}
    want = [(i, b, to.get((i, b)), None if (i, b) in to else b) for i, _, b in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def zipped(wide, comment=b""):
    out = io.BytesIO()
    limit, zipfile.ZIP64_LIMIT, count = zipfile.ZIP64_LIMIT, 10 if wide else zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT
    try:
        with zipfile.ZipFile(out, "w", allowZip64=True) as z:
            for name in ("a", "b/c", "d"):
                z.writestr(name, name.encode() * 100)
            z.writestr("packed", b"x" * 1000, compress_type=zipfile.ZIP_DEFLATED)
            z.comment = comment
    finally:
        zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = limit, count
    return out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a remark"])
def test_directories(wide, comment):
    data = zipped(wide, comment)
    assert (b"PK\x06\x06" in data) == wide
    found = warc.members(io.BytesIO(data), len(data))
    assert set(found) == {"a", "b/c", "d"}
    for name, (at, size) in found.items():
        assert data[at : at + size] == name.encode() * 100
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(data[:-30]), len(data) - 30) if not comment else warc.members(io.BytesIO(b"x"), 1)


def test_package_is_a_zip_file():
    index = []
    data = b"".join(warc.package([(1, b"one"), (2, b"three")], index))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read(warc.ARCHIVE) == b"onethree"
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    assert struct.calcsize("<Q") == 8 and len(index) == 2


# ---- vectors -------------------------------------------------------------------------------


def plain_nearest(ids, x, k=20):
    out = {}
    for q in ids[ids % 20 == 0]:
        score = (x * x[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = vectors.toPandas().sort_values("vec_id")
    want = plain_nearest(frame.vec_id.to_numpy(), np.array(frame.embedding.tolist(), dtype=float))
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert [r for _, _, r in got[q]] == list(range(1, 21))
        assert all(a[1] >= b[1] for a, b in zip(got[q], got[q][1:]))
        hits += len({v for v, _ in best} & {v for v, _, _ in got[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rows = [(n, [1.0, 0.0, 2.0, 0.5], "x") for n in range(60)]  # equal vectors: ties by smaller id
    rows += [(100, None, ""), (101, [0.0] * 4, ""), (102, [1.0, None, 1.0, 1.0], ""), (103, [math.nan, 1.0, 1.0, 1.0], ""), (104, [math.inf, 1.0, 1.0, 1.0], ""), (105, [1.0], ""), (None, [1.0] * 4, ""), (3, [1.0, 0.0, 2.0, 0.5], "again"), (200, [-1.0, 3.0, 0.0, 0.0], "")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, list string")
    got = ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 20, 40, 200}
    assert by[20] == list(range(20)) and by[0] == list(range(1, 21))
    few = ann.nearest(frame.filter("vec_id in (20, 7, 200, 101)"), F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(20, 7), (20, 200), (200, 7), (200, 20)}
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_double_vectors_are_not_narrowed(spark):
    """Scores of array<double> are those of the doubles, and neighbours that only doubles tell apart keep their order."""
    rows = [(n, [1.0 + n * 1e-12, 0.1, 1 / 3, 2.0]) for n in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = plain_nearest(np.arange(60), np.array([v for _, v in rows]))
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [v for v, _ in best] for q, best in got.items()} == {q: [v for v, _ in best] for q, best in want.items()}
    assert all(abs(a - b) < 1e-14 for q in want for (_, a), (_, b) in zip(got[q], want[q]))


# ---- the pipeline --------------------------------------------------------------------------


def test_pipeline(spark, sf, documents, odd, empty):
    import corpus_pipeline
    from test_text_operators import plain_components, plain_contamination, plain_fingerprint, plain_spans

    from askance.llm import langid

    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = stage(spark, docs, sf)
        assert after.columns == documents.columns
        kept = {r.doc_id: r for r in after.collect()}
        if name == "language":
            judged = langid.identify(docs).collect()
            assert set(kept) == {r.doc_id for r in judged if not r.rejected}
        elif name == "near_duplicates":
            comps = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before])
            assert set(kept) == {c for _, _, c in comps} and len(kept) < len(before)
        elif name == "decontamination":
            judged = plain_contamination([(r.doc_id, r.text) for r in before], bench)
            assert set(kept) == {r[0] for r in judged if not r[-1]} and len(kept) < len(before)
        else:
            assert set(kept) == {r.doc_id for r in before}
            assert all(not plain_spans(r.text) and r.n_chars == len(r.text) for r in kept.values())
            assert all(kept[r.doc_id].text == r.text for r in before if not plain_spans(r.text))
        docs = after.cache()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    assert corpus_pipeline.sampled_pieces(spark, odd, sf).count() == odd.count()
