import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": name != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[name]
            if good:
                out.append((kind, *m.span()))
    return out


CASES = [
    "a.b@c.de, x@y, @z.w, a@b.c_d@e.f, q@@r.s a@b.c@d.e é@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4 11.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111", "+1 (988) 555-2485 +44 +1 2 +1234567 (8)",
    "+1 (988) 555-2485 4111111111111111", "", "9" * 5000, "a" * 3000 + "@", "+" * 50 + "1-1-",
]


@pytest.mark.parametrize("text", CASES)
def test_fixed_patterns(text):
    assert pii.fixed_spans(text) == slow(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-_+ 1234(5)0é", max_size=60))
def test_fixed_patterns_on_any_text(text):
    assert pii.fixed_spans(text) == slow(text)


def random_field(rng):
    k = len(pii.TAGS)
    return pii.Field(rng.normal(size=(3, pii.SHAPES, k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k))


def test_viterbi_is_exact():
    """Against all paths, over several texts at once."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        field = random_field(rng)
        field.bias[0] += rng.uniform(0, 8)  # from all words open to nearly none
        shape = rng.integers(1, 50, 12)
        starts = np.array([0, 5, 7])
        last, following = pii.neighbours(shape, starts)
        emissions = field.emissions(shape, last, following)
        got = pii.decode(field, shape, starts)
        for i, j in zip(starts, [5, 7, 12]):
            def score(path):
                total = sum(emissions[i + t, tag] for t, tag in enumerate(path))
                return total + sum(field.move[a, b] for a, b in zip((0, *path), (*path, 0)))

            best = max(itertools.product(range(len(pii.TAGS)), repeat=j - i), key=score)
            assert score(tuple(got[i:j])) == pytest.approx(score(best))


def test_training_raises_the_likelihood_of_the_labels():
    lines = pii.labelled_lines(["write to ann.b@mail.example.com or so", "nothing to see here at all", "call +1 (988) 555-2485 now"])
    field = pii.train(lines)
    for shape, tags in lines:
        assert pii.decode(field, shape, np.array([0])).tolist() == tags.tolist()


def test_shapes_cut_at_ascii_blanks():
    text = " Ab\tc9 é\n\n(x) "
    starts, ends, shape = pii.shapes(text.encode())
    words = [text.encode()[i:j].decode() for i, j in zip(starts, ends)]
    assert words == re.findall(r"[^\x20\x09-\x0D]+", text) and len(shape) == len(words)
    assert all(len(x) == 0 for x in pii.shapes(b"  ")) and all(len(x) == 0 for x in pii.shapes(b""))


@pytest.fixture(scope="module")
def field(spark, data):
    return pii.learn(spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet"))


def test_added_spans(field):
    """Writings the patterns do not know are found; clean text is left alone."""
    for text, part in {
        "inea tion (988) 555-2485 thnd": "(988) 555-2485",
        "ouea bosbt.42 (at) mail8.example.com ndwh": "bosbt.42 (at) mail8.example.com",
        "ré 4111.1111.1111.1111 aux": "4111.1111.1111.1111",
    }.items():
        (spans,) = pii.added_spans(field, [text], [pii.fixed_spans(text)])
        assert [text[i:j] for _, i, j in spans] == [part]
    for text in ["Apache License, Version 2.0.", "see 2010-2011 at page 12", "4111.1111.1111.1112 is none", "the of and in"]:
        assert pii.added_spans(field, [text], [[]]) == [[]]


def test_lists_in_a_stretch():
    """Every datum of a stretch counts, also where the pattern joins it with its neighbours."""
    parts = lambda kind, text: [text[i:j] for i, j in pii.plausible(kind, text)]
    assert parts(3, "555-123-4567, 555-987-6543") == ["555-123-4567", "555-987-6543"]
    assert parts(3, "555-123-4567 555-987-6543") == ["555-123-4567", "555-987-6543"]
    assert parts(3, "(988) 555-2485 (977) 555-1234 / 555.987.6543") == ["(988) 555-2485", "(977) 555-1234", "555.987.6543"]
    card = "4111.1111.1111.1111"
    assert parts(2, f"{card} {card} 4111.1111.1111.1112 {card}") == [card] * 3
    assert parts(1, "10.0.0.1 10.0.0.2") == ["10.0.0.1", "10.0.0.2"]
    assert parts(0, "ab (at) c.de f (at) g.hi") == ["ab (at) c.de", "f (at) g.hi"]
    assert parts(3, "201 202 203") == parts(2, "1 " * 400) == []


def test_lists_in_a_text(monkeypatch):
    """Stretches end at lines and fixed spans, whatever the field joins."""
    monkeypatch.setattr(pii, "decode", lambda field, shape, starts: np.full(len(shape), 4))
    texts = [
        "555-123-4567\n555-987-6543\r\n(988) 555-2485", "é 555-123-4567 +1 (988) 555-2485 555-987-6543", "none",
        "+1 (988) 555-2485",
    ]
    fixed = [pii.fixed_spans(text) for text in texts]
    fixed[1] = [(3, 15, 32)]
    found = [[t[i:j] for _, i, j in spans] for t, spans in zip(texts, pii.added_spans(None, texts, fixed))]
    assert texts[1][15:32] == "+1 (988) 555-2485"
    assert found == [["555-123-4567", "555-987-6543", "(988) 555-2485"], ["555-123-4567", "555-987-6543"], [], []]


def test_lists_that_the_field_tags(field):
    for text, wanted in {
        "call (988) 555-2485, (977) 555-1234 or so": ["(988) 555-2485", "(977) 555-1234"],
        "(988) 555-2485\n(977) 555-1234\n(966) 555-4321": ["(988) 555-2485", "(977) 555-1234", "(966) 555-4321"],
    }.items():
        (spans,) = pii.added_spans(field, [text], [pii.fixed_spans(text)])
        assert [text[i:j] for _, i, j in spans] == wanted


def test_find(docs_of, odd_rows, field):
    from pyspark.sql import functions as F

    docs = docs_of(odd_rows).withColumn("_pii", F.lit(1))
    found = pii.find(docs, field).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        text = r["text"] or ""
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["_pii"] if s["fixed"]]
        assert base == slow(text)
        spans = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["_pii"]]
        assert spans == sorted(spans)


def test_empty_tables(docs_of):
    docs = docs_of([])
    assert pii.find(docs, pii.learn(docs)).count() == 0
