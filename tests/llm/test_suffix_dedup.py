import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.llm import suffix_dedup as sd


def slow(rows):
    """By the definition, every string of 100 bytes in corpus order; rows without id are left out."""
    seen, out = set(), {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - sd.LENGTH + 1):
            string = data[at : at + sd.LENGTH]
            if string in seen:
                gone[at : at + sd.LENGTH] = b"\1" * sd.LENGTH
            seen.add(string)
        edges = [i for i in range(len(gone) + 1) if (gone[i - 1] if i else 0) != (gone[i] if i < len(gone) else 0)]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), list(zip(edges[::2], edges[1::2])), hashlib.sha256(kept).hexdigest(), kept)
    return out


def compare(docs, rows, crowd=sd.CLASS):
    want = slow(rows)
    found = [r for r in sd.remove_repeats(docs, crowd).collect()]
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            spans = [(s["start"], s["end"]) for s in r["spans"]]
            n, runs, digest, kept = want[r["doc_id"]]
            assert (r["n_bytes"], spans, r["kept_sha256"]) == (n, runs, digest)
            assert (r["kept"] is None) == (not spans) and (not spans or bytes(r["kept"]) == kept)
    return found


def corpus():
    rng = random.Random(8)
    words = ["la", "estación", "of", "the", "und", "größe", "x", "tion", "42"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage, line = prose(40), "All rights reserved, whoever you are, wherever you read this line of more than 100 bytes, every one."
    rows = []
    for i in range(60):
        text = prose(rng.randrange(5, 60))
        if i % 3 == 0:
            text += passage[rng.randrange(30) :] + prose(9)
        if i % 4 == 0:
            text = line + "\n" + text + "\n" + line
        if i % 7 == 0 and rows:
            text = rows[-1][1]
        if i % 11 == 0 and rows:
            text = rows[-2][1][: rng.randrange(400)] + "Z" + rows[-2][1][rng.randrange(100) :]
        rows.append((i * 3, text))
    return rows + [(200, "a" * 700), (201, "ab" * 300), (199, "a" * 99), (198, "a" * 100), (202, "abc " * 200)]


def test_against_brute_force(docs_of):
    rows = corpus()
    random.Random(1).shuffle(rows)
    compare(docs_of(rows), rows)
    compare(docs_of(rows, parts=1), rows, crowd=2)  # nearly all classes are crowded


def test_long_texts_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 300)
    monkeypatch.setattr(sd, "CONTEXTS_HELD", 20)
    monkeypatch.setattr(sd, "ANCHORS_AT_ONCE", 7)
    monkeypatch.setattr(sd, "ROWS_AT_ONCE", 9)
    rows = corpus()
    compare(docs_of(rows), rows)


def test_odd_rows(docs_of, odd_rows):
    found = compare(docs_of(odd_rows), odd_rows)
    lost = [r for r in found if r["doc_id"] is None and r["n_bytes"] and r["spans"]]
    assert lost  # the copy without an id comes after the one with id 5


def test_empty_table(docs_of):
    assert sd.remove_repeats(docs_of([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_blind_tries_sort(strings):
    assert [strings[i] for i in sd.blind_trie_order(strings)] == sorted(strings)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=24, max_size=24).map(lambda b: bytes(x % 2 for x in b))), min_size=1, max_size=40))
def test_deep_shallow_sorts_within_groups(rows):
    groups = np.array([g for g, _ in rows])
    data = np.frombuffer(b"".join(s for _, s in rows), np.uint8).reshape(-1, 24)
    order, common = sd.deep_shallow(groups, data, 8)
    assert [rows[i] for i in order] == sorted(rows)
    for n, (i, j) in enumerate(zip(order[:-1], order[1:]), 1):
        same = next((k for k in range(24) if rows[i][1][k] != rows[j][1][k]), 24)
        assert common[n] == (same if groups[i] == groups[j] else -1)


def test_anchors_follow_from_the_string():
    """Every string has one anchor, whose place in it depends on its bytes only."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 900).astype(np.uint8)
    data[500:700] = data[100:300]
    at, h, part, first, last = sd.anchors(data, np.array([0, 450]), np.array([450, 900]))
    place = {}
    for a, p, i, j in zip(at, part, first, last):
        for s in range(i, j + 1):
            assert 0 <= a - s <= sd.BEFORE
            place[s] = a - s
    assert sorted(place) == [*range(0, 351), *range(450, 801)]
    assert all(place[s] == place[s + 400] for s in range(100, 201))
