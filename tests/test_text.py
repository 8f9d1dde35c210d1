"""Cleaning rules on literal rows, each against a few lines of plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textwarden import config
from textwarden.functions import text as T

TEXTS = [
    "",
    "   ",
    "   \t",
    "  padded text here  ",
    " wide　spaces  inside ",
    "a\x1cb\x1dc d",
    "hi",
    "two words",
    "now three words",
    "You are stuuuuuupid",
    "line\n\n\n\nbreaks\r\r\r\rand     more",
    "🔥🔥🔥🔥 so hot",
    "तुम एक बेवकूफ और बेकार इंसान हो",
    "أنت غبي ولا تستحق الاحترام",
    "MIXED Case_with under_score & sym-bols!!! 123",
    "x" * 5000,
    "x" * 5001,
    "word " * 700,
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def apply(rows, column):
    return [row[0] for row in rows.orderBy("id").select(column).collect()]


def collapse(text):
    return re.sub(r"(.)\1{2,}", r"\1\1", text)


def test_space_set_is_the_one_of_str_isspace():
    assert set(T.SPACE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip(rows):
    assert apply(rows, T.strip(F.col("text"))) == [t.strip() for t in TEXTS]


def test_word_count(rows):
    assert apply(rows, T.word_count(F.col("text"))) == [len(t.split()) for t in TEXTS]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_has_words(rows, n):
    assert apply(rows, T.has_words(T.strip(F.col("text")), n)) == [len(t.split()) >= n for t in TEXTS]


def test_collapse_repeats(rows):
    assert apply(rows, T.collapse_repeats(F.col("text"))) == [collapse(t) for t in TEXTS]


def test_collapse_is_idempotent(rows):
    once = T.collapse_repeats(F.col("text"))
    assert apply(rows, once) == apply(rows, T.collapse_repeats(once))


def test_sanitise(rows):
    assert apply(rows, T.sanitise(F.col("text"))) == [collapse(t.strip()) for t in TEXTS]


def test_normalise_strict(rows):
    want = [re.sub(r"[^\w\s]", "", collapse(t.lower())) for t in TEXTS]
    assert apply(rows, T.normalise_strict(F.col("text"))) == want


def test_normalise_strict_may_keep_marks(rows):
    kept = apply(rows, T.normalise_strict(F.col("text"), keep_marks=True))
    assert kept[12] == TEXTS[12]


def test_warnings(rows):
    def want(text):
        words = len(text.split())
        if words == 0:
            return [config.BLANK_WARNING]
        return [config.SHORT_WARNING % words] if words < 3 else []

    assert apply(rows, T.warnings(T.strip(F.col("text")))) == [want(t) for t in TEXTS]


@pytest.mark.parametrize("n", [80, 60, 40])
def test_preview(rows, n):
    want = [t[:n] + "..." if len(t) > n else t for t in TEXTS]
    assert apply(rows, T.preview(F.col("text"), n)) == want


def test_tokens_keep_marks_and_whole_texts(rows):
    tokens = apply(rows, T.tokens(F.col("text")))
    assert tokens[0] == []
    assert tokens[12] == ["तुम", "एक", "बेवकूफ", "और", "बेकार", "इंसान", "हो"]
    assert tokens[14] == ["mixed", "case", "with", "under", "score", "sym", "bols", "123"]
    assert len(tokens[-1]) == 700
    assert len(apply(rows, T.tokens(F.col("text"), 512))[-1]) == 512


def test_label_key_and_numbers(spark):
    row = spark.range(1).select(
        T.label_key(F.lit("Not Toxic")).alias("label"),
        T.percent(F.lit(0.7333)).alias("percent"),
        T.fixed(F.lit(0.66667), 2).alias("fixed"),
    )
    assert tuple(row.first()) == ("not_toxic", "73.3%", "0.67")


def test_null_text_stays_null(spark):
    row = spark.createDataFrame([(None,)], "text string").select(
        T.sanitise(F.col("text")), T.word_count(F.col("text")), T.preview(F.col("text"), 5)
    )
    assert row.first()[0] is None


# Few letters and many kinds of space make runs, blanks and paddings likely.
ALPHABET = st.one_of(st.sampled_from("aab!.  \n\r\t\x0b\x1c\x85\xa0\u2003\u2028🔥ह"), st.characters(exclude_categories=["Cs", "Cn"]))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=100, max_size=300))
def test_any_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    text = F.col("text")
    got = rows.orderBy("id").select(
        T.strip(text), T.word_count(text), T.collapse_repeats(text), T.preview(text, 5),
        T.has_words(T.strip(text), 3),
    ).collect()
    want = [
        (t.strip(), len(t.split()), collapse(t), t[:5] + "..." if len(t) > 5 else t, len(t.split()) >= 3)
        for t in texts
    ]
    assert [tuple(row) for row in got] == want
