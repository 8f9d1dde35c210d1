import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, id string, key string, host string"
"""Documents, and extra columns whose names operators use inside."""


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from ``(doc_id, text[, lang[, source]])`` rows."""

    def make(rows, parts=3):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", "y", None, "z"))
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, rows without an id."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "niño", "straße", "the", "of", "und", "que", "42", "a@b.co"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(30_000)
    copy = prose(80)
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, long, "de", "b"),
        (5, copy, "es", "a"), (6, copy, "es", "a"), (6, copy, "es", "a"), (7, copy + " more", "fr", "b"),
        (8, "one two", "fr", "c"), (9, "...!!! 123", "en", "c"), (None, copy, None, None),
        (None, prose(50), "en", "c"), (None, None, None, None), (10, "x" * 5000, "en", "a"),
        *[(20 + i, prose(20 + i), rng.choice(["en", "de", "fr", "es"]), rng.choice("abc")) for i in range(30)],
    ]


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA
