"""Sentence ranks and summaries against a plain graph of sentence pairs."""

import re

import numpy as np
from pyspark.sql import functions as F

from askance.functions import text as tx
from askance.operators import retrieval, summary


def plain_summary(text, longest=256):
    """Every pair of sentences is looked at; floors where the operator has floors."""
    if text is None:
        return None
    sentences = [s for s in (p.strip() for p in re.split(r"(?<=[.!?])[ \t\n\v\f\r]+", text)) if s]
    if not sentences:
        return None
    bags = [{w for w in re.split(r"[\W_]+", s.lower()) if w} for s in sentences]
    n, rank = len(bags), [10**9] * len(bags)
    link = [[len(a & b) if i != j else 0 for j, b in enumerate(bags)] for i, a in enumerate(bags)]
    for _ in range(summary.ROUNDS):
        share = [rank[j] // sum(link[j]) if sum(link[j]) else 0 for j in range(n)]
        rank = [150_000_000 + 85 * sum(link[j][i] * share[j] for j in range(n)) // 100 for i in range(n)]
    order = sorted(range(n), key=lambda i: (-rank[i], i))
    taken, room = [], longest
    for i in order[: -(-n // 3)]:
        room -= len(sentences[i].split())
        if room < 0:
            break
        taken.append(i)
    return " ".join(sentences[i] for i in sorted(taken)) if taken else " ".join(sentences[order[0]].split()[:longest])


def summaries(spark, texts, **kw):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(3)
    return [r.s for r in frame.select("n", summary.ranked_summary(F.col("t"), **kw).alias("s")).orderBy("n").collect()]


def test_summaries_are_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(tx.page_text(F.col("html")).alias("t"))
    texts = [r.t for r in pages.limit(25).collect()]
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    texts += [" ".join(" ".join(rng.choice(words, int(rng.integers(1, 9)))) + rng.choice([".", "!", "?"]) for _ in range(int(rng.integers(1, 40)))) for _ in range(60)]
    assert summaries(spark, texts) == [plain_summary(t) for t in texts]
    assert summaries(spark, texts, longest=12) == [plain_summary(t, 12) for t in texts]


def test_odd_pages(spark):
    long = "word " * 400 + "end."
    got = summaries(spark, [None, "", " \n", "...", "One sentence only", long, "A. A. A. A.", "é? 中文。 ! x"])
    assert got[:5] == [None, None, None, "...", "One sentence only"]
    assert got[5] == " ".join(["word"] * 256)
    assert got[6] == "A. A." and got[7] == plain_summary("é? 中文。 ! x")


def test_a_summary_reads_the_whole_page(spark):
    """The telling sentence stands at the very end of a page of several thousand words."""
    filler = " ".join(f"Filler{i} alone{i} here{i}." for i in range(1_500))
    centre = "Common thread words join. Common thread words meet. Common thread words stay."
    got = summaries(spark, [filler + " " + centre])[0]
    assert "Common thread words join." in got and 1 <= len(got.split()) <= 256


def test_curated_rows_carry_the_page_summary(spark):
    pages = spark.createDataFrame([(1, "u", "Red fox runs. Red fox sleeps. Blue sky. Red fox eats."), (2, "v", "Nothing else.")], "page_id bigint, url string, full_text string")
    asked = spark.createDataFrame([(7, "red fox")], "q_id bigint, prompt string")
    rows = retrieval.curate(asked, pages, retrieval.lexical_search(pages)).collect()
    assert [(r.page_id, r.summary_text) for r in rows] == [(1, plain_summary("Red fox runs. Red fox sleeps. Blue sky. Red fox eats."))]
    leading = retrieval.curate(asked, pages, retrieval.lexical_search(pages), retrieval.lead_summary).first()
    assert leading.summary_text.startswith("Red fox runs. Red fox sleeps.")


def test_a_batch_is_read_page_by_page():
    import tracemalloc

    import pyarrow as pa

    page = [f"w{i} " + "x" * 200 for i in range(20)]
    words = [[s] for s in page]
    texts, tokens = pa.array([page] * 2000 + [None, []]), pa.array([words] * 2000 + [None, []])
    batch = pa.StructArray.from_arrays([texts, tokens], ["sentences", "tokens"])
    tracemalloc.start()
    got = summary._summaries(batch, 5).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2002 and got[0] and got[-2:] == [None, None]
    assert peak < 4_000_000  # all sentences at once take ten
