import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askance.functions import fixed
from askance.functions import text as tx


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


ODD = ["", " ", "a", "　a b ", "\x1c\x1dx\x85y ", "a\tb\n c", "no space", "​keep"]


def test_strip_and_words_are_pythons(spark):
    assert values(spark, tx.strip, *ODD) == [t.strip() for t in ODD]
    assert values(spark, tx.words, *ODD) == [t.split() for t in ODD]


def test_white_space_set_is_pythons():
    assert set(fixed.WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_random_texts_split_like_python(spark):
    seen = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.text(alphabet=st.sampled_from(list(fixed.WHITE_SPACE) + list("ab.é😀")), max_size=12))
    def gather(t):
        seen.append(t)

    gather()
    assert values(spark, tx.words, *seen) == [t.split() for t in seen]
    assert values(spark, tx.strip, *seen) == [t.strip() for t in seen]


def test_trigrams(spark):
    texts = ["", "ab", "abc", "aBcABC", "é😀x\ny"]
    want = [list(dict.fromkeys(t.lower()[i : i + 3] for i in range(len(t) - 2))) for t in texts]
    assert values(spark, tx.trigrams, *texts) == want


def test_sentences(spark):
    assert values(spark, tx.sentences, "One. Two!  Three?\nFour", "  ", "3.14 is pi.") == [
        ["One.", "Two!", "Three?", "Four"], [], ["3.14 is pi."]]


def test_cut_words(spark):
    text = "a b c d"
    assert values(spark, lambda c: tx.cut_words(c, 2), text, "a b") == ["a b", "a b"]
    # a text with fewer blanks than asked for loses its last character in compat mode
    assert values(spark, lambda c: tx.cut_words(c, 2, compat=True), text, "a b", "") == ["a b", "a ", ""]


def test_tokens_go_one_after_another(spark):
    got = values(spark, lambda c: tx.remove_tokens(c, ["<s>", "</s>"]), "<<s>s>x</s>", "</<s>s>y")
    assert got == ["<s>x", "y"]


@pytest.mark.parametrize("row", fixed.TEMPLATES, ids=[r[0] for r in fixed.TEMPLATES])
def test_render_then_extract_gives_the_response(spark, row):
    model = row[0]
    shown = values(spark, tx.render(model), " Why?\r\n\r\nNow ")[0]
    raw = spark.createDataFrame([(shown + " Since. ",)], "t string").select(tx.extract(model)(F.col("t"))).first()[0]
    assert "Why?" in shown
    if model != "baseline":
        assert raw == ("Since." if row[4] else " Since. ")
    if row[5]:
        assert "Why?\nNow" in shown


def test_extract_without_marker_keeps_all(spark):
    assert values(spark, tx.extract("microsoft/Phi-3-mini-4k-instruct"), " plain ") == ["plain"]
    assert values(spark, tx.extract("Intel/neural-chat-7b-v3-3"), " plain ") == [" plain "]


def test_verdicts(spark):
    texts = ["Yes.", " YES it is", "Not sure", "PARTLY.", "", "maybe", "no"]
    assert values(spark, tx.verdict_score, *texts) == [1.0, 1.0, 0.0, 0.5, -99.0, -99.0, 0.0]


def test_threshold_and_nan(spark):
    rows = spark.createDataFrame([(float("nan"),), (0.5,), (0.5000001,), (None,)], "s double")
    assert [r[0] for r in rows.select(tx.hallucinated(F.col("s"))).collect()] == [False, False, True, False]


def test_page_text(spark):
    html = (
        "<html><head><title>T</title></head><body><script>var t='</p><nav>';</script><nav>menu</nav>"
        "<p>A &amp; B</p><!-- c --><div>x &lt;y&gt;</div><footer>f</footer></body></html>"
    )
    assert values(spark, tx.page_text, html, "<p> </p>") == ["A & B\nx <y>", "-"]


def test_answer_tokens(spark):
    assert values(spark, tx.answer_tokens, "The Cat, a hat!", "là an été", "") == [["cat", "hat"], ["là", "été"], []]
