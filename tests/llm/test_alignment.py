"""Cross-tokenizer alignment against a version that goes through links one by one."""

import hashlib
from collections import Counter

import pytest

from textwarden.llm import alignment, queries
from textwarden.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers, text by text, and the bytes of their tokens."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    decoder = decoders.ByteLevel()
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}
    assert decoder.decode(["Ġhi"]) == " hi"

    def tokens(text):
        if not text:
            return [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        of_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids_a]
        of_b = []
        for i in ids_b:
            piece = b.id_to_piece(i)
            of_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in of_a) != want or b"".join(x for _, x in of_b) != want:
            return [], []
        return of_a, of_b

    return tokens


def brute(rows, tokens):
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row, sorted."""
    found = []
    for doc_id, text in rows:
        a, b = tokens(text)
        ends_a, ends_b, at = [], [], 0
        for _, data in a:
            at += len(data)
            ends_a.append(at)
        at = 0
        for _, data in b:
            at += len(data)
            ends_b.append(at)
        at_a = {end: i for i, end in enumerate(ends_a)}
        links = [(a[at_a[end]][0], b[j][0]) for j, end in enumerate(ends_b) if end in at_a]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            left, right = [], []
            while i < len(a) and ends_a[i] <= cut:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                right.append(str(b[j][0]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((doc_id, len(a), len(b), len(groups), links, digest))
    count = Counter(link for row in found for link in row[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (
            (i, n_a, n_b, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), sha)
            for i, n_a, n_b, g, ls, sha in found
        ),
        key=str,
    )


def got(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


ODD = [
    "<|endoftext|> is text <s> </s> <0x41> <unk>", "a▁b", "  two  blanks \n\n lines\t", "\U0001f600 naïve عرب हि",
    "x", " ", "\x00 zero \x1c\x85", "the the the the the", "ab" * 400,
]


def test_odd_rows(spark, docs_of, odd_rows, plain):
    rows = odd_rows + [(100 + i, text) for i, text in enumerate(ODD)] * 2
    want = brute([(row[0], row[1]) for row in rows], plain)
    for block_docs, block_links in ((1 << 14, 4_000_000), (3, 10**9), (1 << 16, 50)):
        found = alignment.align(docs_of(rows), vocabulary(A), vocabulary(B), block_docs, block_links)
        assert got(found) == want


def test_empty_and_alone(spark, docs_of, plain):
    found = alignment.align(docs_of([(1, "x")]).where("doc_id > 5"), vocabulary(A), vocabulary(B))
    assert found.collect() == []
    found = alignment.align(docs_of([(1, None), (2, "")]), vocabulary(A), vocabulary(B))
    assert got(found) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_are_cut_without_effect(monkeypatch):
    text = " ".join(f"word{i} \n tail  it's" for i in range(300))
    with open(vocabulary(A), encoding="utf-8") as file:
        tokenizer = alignment.ByteLevel(file.read())
    whole = tokenizer.encode([text])[0].tolist()
    monkeypatch.setattr(alignment, "TEXT_AT_ONCE", 50)
    assert tokenizer.encode([text])[0].tolist() == whole


def test_pair_counts(spark, docs_of):
    docs = docs_of([(1, "the cat the cat the"), (2, "the cat"), (3, "the")])
    rows = alignment.encoded(docs, vocabulary(A), vocabulary(B))
    pairs = {(r.n_docs, r.n_links) for r in alignment.pair_counts(rows).collect()}
    assert pairs == {(3, 5), (2, 3)}


def test_query(spark, data, plain):
    import duckdb

    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    assert got(queries.registry()["op13_alignment"](spark, data)) == brute(rows, plain)


def test_words_are_encoded_once():
    """Ids of words between safe cuts are those of the whole text, and a repeated word is not encoded again."""
    import random

    from tokenizers import Tokenizer

    with open(vocabulary(A), encoding="utf-8") as file:
        a = alignment.ByteLevel(file.read())
    rng = random.Random(4)
    parts = [" ", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "​", "a", "b'", "'s", "é", "12", "!", "\r",
             "<|endoftext|>", "x" * 70, "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    plain = Tokenizer.from_file(vocabulary(A))
    plain.encode_special_tokens = True
    assert [ids.tolist() for ids in a.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    seen = []

    class Counted:
        def encode_batch_fast(self, texts, **settings):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **settings)

    a.tokenizer = Counted()
    text = " the swiftest bird of all" + " and the swiftest bird again" * 500
    (ids,) = a.encode([text])
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sum(map(len, seen)) < 100


def test_words_are_aligned_once(monkeypatch):
    """Texts put together from remembered words are those aligned as a whole, whatever stands between the words."""
    with open(vocabulary(A), encoding="utf-8") as file, open(vocabulary(B), "rb") as other:
        aligner = alignment.Aligner(file.read(), other.read())
    assert aligner.by_words
    texts = ["one two  three", " one two ", "\tone　two\n three", "one ▁two", "▁ one", "á b c​ d", "<s> one</s>", " ", None, "", "x\ud800"]
    found = []
    for text, pair in zip(texts, aligner.tokens(texts)):
        if pair is None:
            found.append(None)
            continue
        last_a, last_b = aligner.groups(*pair)
        links = ((pair[0][last_a] << 32) | pair[1][last_b]).tolist()
        found.append((len(pair[0]), len(pair[1]), hashlib.sha256(aligner.written(*pair, last_a, last_b)).hexdigest(), links))
    plain = lambda rows: [row and (*row[:3], row[3].tolist()) for row in rows]
    assert plain(aligner.aligned(texts)) == found
    once = plain(aligner.aligned(["one two"]))
    monkeypatch.setattr(aligner, "learn", lambda words: pytest.fail(f"again: {words}"))
    assert plain(aligner.aligned(["one two"] * 3)) == once * 3
