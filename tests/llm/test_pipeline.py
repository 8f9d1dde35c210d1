import os
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from textwarden.llm import lang_id, line_dedup, mixing
from textwarden.llm.queries import registry, sql, vocabulary

TABLES = "documents embeddings pages benchmark labels conversations"


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in registry()} == {f"op{i}" for i in range(1, 11)}
    assert set(registry()) | {"pipeline"} <= set(names) and set(sql()) <= set(entry.oracle_sql())


def test_stages_against_brute_force(spark, docs_of, odd_rows):
    """Every stage's effect, and the whole run's tokens, recomputed row by row."""
    from tokenizers import Tokenizer

    from test_simhash import slow_groups

    rows = odd_rows + [(600 + i, f"menu of the day\nthis is text {i} of the many", "en", "m") for i in range(30)]
    docs = docs_of(rows)
    kept = rows
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, "/nowhere"), "stage")
        frames.append(docs)
        if len(frames) < len(corpus_pipeline.STAGES):
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    pairs = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)
    kept = [r for r in rows if lang_id.has_letter(r[1])]
    assert pairs(frames[0]) == sorted(((r[0], r[1]) for r in kept), key=str)
    lines, pages = defaultdict(int), defaultdict(int)
    for _, text, _, source in kept:
        pages[source] += 1
        for line in {x.strip(" ") for x in text.split("\n") if x.strip(" ")}:
            lines[source, line] += 1
    often = lambda s, x: lines[s, x.strip(" ")] >= line_dedup.MIN_PAGES and lines[s, x.strip(" ")] > line_dedup.RATIO * pages[s]
    kept = [(i, "\n".join(x for x in t.split("\n") if not often(s, x)), lang, s) for i, t, lang, s in kept]
    assert pairs(frames[1]) == sorted(((r[0], r[1]) for r in kept), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in frames[1].collect())
    first = {min(group) for group in slow_groups([(i, t) for i, t, *_ in kept if i is not None])}
    once = {r[0]: r for r in kept if r[0] in first}
    kept = [*once.values(), *(r for r in kept if r[0] is None)]
    assert pairs(frames[2]) == sorted(((r[0], r[1]) for r in kept), key=str)
    copies = defaultdict(int)
    for r in mixing.mix(frames[2]).collect():
        copies[r["doc_id"]] += r["copies"]
    times = defaultdict(int)
    for r in frames[3].collect():
        times[r["doc_id"]] += 1
    assert dict(times) == {i: n for i, n in copies.items() if n}
    library = Tokenizer.from_file(vocabulary())
    want = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in frames[3].collect()]
    got = [(r["doc_id"], r["ids"]) for r in frames[4].collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_run(spark, data):
    found = corpus_pipeline.run(spark, data)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and found.count() > 0


@pytest.mark.parametrize("name", sorted(sql()))
def test_queries_against_sql(spark, data, name):
    folder = data.replace("0.001", "0.01")
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"create view {table} as select * from '{os.path.join(folder, table)}.parquet'")
    want = con.execute(sql()[name]).df()
    got = registry()[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
