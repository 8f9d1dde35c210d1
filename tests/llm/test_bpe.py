import pytest

from textwarden.llm import bpe, queries
from textwarden.llm.queries import vocabulary

EXTRA = [
    "Hello, WORLD! it's 3.14 <|endoftext|>x <|ENDOFTEXT|> foo<|startoftext|>bar",
    "é J̌ İ K K̇ ÉtÉ ΟΔΟΣ Σ", "tabs\tand\x0bfeeds\x0c\r\n\x1c\x85  done",
    "日本語テキスト 😀👍🏽 ñ̃", "\x00\x01 zero", "'S 'LL don'T we'VE", "a" * 3000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_against_the_library(docs_of, odd_rows, library):
    rows = odd_rows + [(1000 + i, text, None, None) for i, text in enumerate(EXTRA)]
    for block_words in (bpe.BLOCK_WORDS, 25):
        encoded = bpe.encode(docs_of(rows), vocabulary(), block_words)
        found = bpe.decode(encoded, vocabulary()).collect()
        want = []
        for doc_id, text, *_ in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            want.append((doc_id, ids, library.decode(ids, skip_special_tokens=False)))
        order = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in found), key=order) == sorted(want, key=order)
        both = bpe.encode(docs_of(rows), vocabulary(), block_words, decoded=True).collect()
        assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in both), key=order) == sorted(want, key=order)


def test_query(spark, data, library):
    import hashlib

    import duckdb

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for doc_id, text in duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    found = queries.op5_bpe(spark, data).collect()
    assert {row["doc_id"]: tuple(row[name] for name in names) for row in found} == want and len(found) == len(want)


def test_packing():
    import numpy as np

    for numbers in ([], [0], [5, 70_000, 2**32 - 1]):
        assert bpe.unpack(bpe.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [-1, 49407, 10**6], "x")], "k int, ids array<int>, decoded string")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df, vocabulary()).collect()}
    assert got == {1: "", 2: "", 3: "<|endoftext|>"}


def test_empty_table(docs_of):
    assert bpe.decode(bpe.encode(docs_of([]), vocabulary()), vocabulary()).count() == 0
