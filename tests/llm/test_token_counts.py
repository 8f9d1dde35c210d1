import re

import pytest
from pyspark.sql import functions as F

from textwarden.llm import token_counts as tc
from textwarden.llm.common import shared_path

CHANGE = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def test_commits_are_additive_and_idempotent(spark):
    rollup = tc.Rollup(spark, shared_path(spark, "rollup"))
    assert rollup.totals().count() == 0 and rollup.batches() == []
    first = spark.createDataFrame([("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, 7)], CHANGE)
    assert rollup.commit("one", first)
    assert totals(rollup) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 7)}
    assert not rollup.commit("one", first.union(first))  # a replay
    assert totals(rollup) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 7)}
    # a delete, and a count that was revised from 5 to 6
    change = spark.createDataFrame([(None, None, "v1", -1, -7), ("a", "en", "v1", -1, -5), ("a", "en", "v1", 1, 6)], CHANGE)
    assert rollup.commit("two", change)
    assert totals(rollup) == {("a", "en", "v1"): (2, 16)}
    assert rollup.commit("none", change.limit(0)) and rollup.batches() == ["none", "one", "two"]
    assert totals(tc.Rollup(spark, rollup.path)) == {("a", "en", "v1"): (2, 16)}
    with pytest.raises(ValueError):
        rollup.commit("../x", change)


def test_a_lost_race_changes_nothing(spark, monkeypatch):
    rollup = tc.Rollup(spark, shared_path(spark, "rollup"))
    first = spark.createDataFrame([("a", "en", "v1", 1, 10)], CHANGE)
    assert rollup.commit("one", first)
    seen = iter([False, True])  # the other writer came between the look and the rename
    monkeypatch.setattr(rollup, "_exists", lambda path: next(seen))
    assert not rollup.commit("one", first)
    monkeypatch.undo()
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)}


def slow(rows):
    """Counts by hand: one document of each text, without its repeated lines."""
    first = {}
    for doc_id, text, lang, source in rows:
        order = (doc_id is None, doc_id or 0, source is None, source or "", lang is None, lang or "")
        if text not in first or order < first[text][0]:
            first[text] = (order, source, lang)
    out = {}
    for text, (_, source, lang) in first.items():
        line = "\n".join(dict.fromkeys((text or "").split("\n")))
        for name, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", line))), ("pieces-1", None)):
            if n is None:
                import regex

                n = len(regex.findall(r"[\p{L}\p{M}]+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]", line))
            docs, tokens = out.get((source, lang, name), (0, 0))
            out[source, lang, name] = (docs + 1, tokens + n)
    return out


def test_life_of_a_corpus(spark, docs_of, odd_rows):
    rows = odd_rows + [(500, "same\nsame\nother 1\nsame", "en", "a"), (501, "same\nsame\nother 1\nsame", "de", "b")]
    rollup = tc.Rollup(spark, shared_path(spark, "rollup"))
    assert tc.maintain(docs_of(rows), rollup) == [True, True, True, False]
    assert totals(rollup) == slow(rows)


def test_empty_table(spark, docs_of):
    rollup = tc.Rollup(spark, shared_path(spark, "rollup"))
    tc.maintain(docs_of([]), rollup)
    assert rollup.totals().count() == 0


def test_null_text_has_no_tokens(spark):
    df = spark.createDataFrame([(None,)], "t string").select(F.inline(tc.counts(F.col("t"))))
    assert [r["tokens"] for r in df.collect()] == [0, 0]
