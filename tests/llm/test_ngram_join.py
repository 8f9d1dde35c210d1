"""N-gram Jaccard join against all pairs."""

import random

import pytest

from textwarden.llm import ngram_join, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=3):
    words = [w.decode() for w in (text or "").translate(LOWER).encode("utf-8", "replace").split()]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=90):
    """``(doc_id, n_shingles, component_id)`` of every row by all pairs."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(row) for row in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Near copies around the threshold, chains of them, texts that share a long passage, short texts."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    out = []
    base = [word() for _ in range(150)]
    out += [edited(rng, base, rng.randrange(8)) for _ in range(120)]
    chain = [word() for _ in range(120)]
    for i in range(30):
        out.append(" ".join(chain))
        chain[(4 * i) % 120] = f"link{i}"
        chain[(4 * i + 1) % 120] = f"link{i}b"
    passage = [word() for _ in range(60)]
    out += [" ".join(passage + [word() for _ in range(rng.randrange(1, 9))]) for _ in range(60)]
    out += [" ".join([word() for _ in range(rng.randrange(1, 40))]) for _ in range(150)]
    out += ["one two", "ONE Two", "one", "one\ttwo\x0bthree", "one two three", "É è", "é è", "\x85 \x1c"]
    out += out[:20]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out))


def test_all_pairs(spark, docs_of, rows):
    assert got(ngram_join.join(docs_of(rows))) == brute(rows)


def test_other_similarity(spark, docs_of, rows):
    some = rows[:150] + rows[-60:]
    assert got(ngram_join.join(docs_of(some), percent=70)) == brute(some, 70)


def test_without_broadcast_or_leaders(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "BYTES_AT_ONCE", 64)
    some = rows[:200]
    assert got(ngram_join.join(docs_of(some))) == brute(some)


def test_odd_rows(spark, docs_of, odd_rows):
    want = brute([(row[0], row[1]) for row in odd_rows])
    assert got(ngram_join.join(docs_of(odd_rows))) == want


def test_no_rows(spark, docs_of):
    assert ngram_join.join(docs_of([(1, "x")]).where("doc_id > 5")).collect() == []
    assert got(ngram_join.join(docs_of([(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


def test_query(spark, data):
    import duckdb

    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    assert got(queries.registry()["op12_ngram_join"](spark, data)) == brute(rows)


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, also in texts cut to pieces; others differ."""
    rng = random.Random(2)
    for _ in range(50):
        words = ["".join(rng.choice("ab\x00é") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60))]
        data = (rng.choice([" ", "\n", "\t \r"]) * rng.randrange(2) + " ".join(words) + "\x0b" * rng.randrange(2)).encode()
        monkeypatch.setattr(ngram_join, "BYTES_AT_ONCE", rng.choice([1, 7, 1 << 20]))
        found = ngram_join.word_hashes(data).tolist()
        assert len(found) == len(words)
        assert len(set(zip(words, found))) == len(set(words)) == len(set(found))


def test_frequent_tokens_stand_last(spark, docs_of):
    """A shingle that one text in twelve holds is told from those of one text, though it adds a fifth to its slot only."""
    rng = random.Random(4)
    shared = "a shared phrase"
    rows = [
        (i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(400)] + [shared] * (i % 12 == 0))) for i in range(1000)
    ]
    before = ngram_join.SLOT_BITS, ngram_join.SLOTS
    ngram_join.SLOT_BITS, ngram_join.SLOTS = 10, 1 << 10  # some 400 tokens a slot
    try:
        classes = ngram_join.slot_classes(docs_of(rows), 3)
        slots = [int(t) >> 54 for t in ngram_join.shingle_set(shared, 3)]
    finally:
        ngram_join.SLOT_BITS, ngram_join.SLOTS = before
    assert all(classes[s] > 0 for s in slots) and (classes > 0).mean() < 0.1
