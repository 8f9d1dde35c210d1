import zlib

from pyspark.sql import functions as F

from textwarden.llm import lang_id


def test_grams_cover_a_long_text_once(monkeypatch):
    text = "Straße und Über " * 400
    whole = lang_id.features(text)
    monkeypatch.setattr(lang_id, "PIECE", 64)
    assert abs(lang_id.features(text) - whole).max() < 1e-12
    assert lang_id.folded("É9 A--b") == " é a b ".encode()


def test_held_out_accuracy_and_independence(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    model = lang_id.train(docs)
    assert set(model.families) == {"germanic", "romance"}
    hidden = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    found = {r["doc_id"]: r for r in lang_id.identify(hidden, model).collect()}
    rows = docs.collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(found[r["doc_id"]]["_lang_pred"] == r["lang"] for r in out)
    assert len(out) > 100 and right / len(out) > 0.97
    assert all(0 <= r["_lang_score"] <= 1 for r in found.values())


def test_learns_only_from_its_part(docs_of):
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    out = [i for i in range(200) if i not in kept]
    rows = [(i, "aaa bbb abab", "en", None) for i in kept[:20]] + [(i, "zzz yyy zyzy", "ru", None) for i in kept[20:40]]
    rows += [(i, "qqq www qwqw", "xx", None) for i in out] + [(None, "eee", "yy", None), (kept[50], "rrr", None, None)]
    model = lang_id.train(docs_of(rows))
    assert model.families == {"germanic": ["en"], "slavic": ["ru"]}
    got = {r["doc_id"]: r["_lang_pred"] for r in lang_id.identify(docs_of(rows), model).collect()}
    assert got[kept[0]] == "en" and got[kept[20]] == "ru"


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumn("_lang_pred", F.lit(1))
    found = lang_id.identify(docs, lang_id.train(docs)).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        has = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["_lang_pred"] == "und") == (not has) and 0 <= r["_lang_score"] <= 1


def test_empty_table_and_nothing_to_learn(docs_of):
    docs = docs_of([])
    assert lang_id.identify(docs, lang_id.train(docs)).count() == 0
    docs = docs_of([(1, "some text", None, None)])
    assert [r["_lang_pred"] for r in lang_id.identify(docs, lang_id.train(docs)).collect()] == ["und"]


def test_pipeline_keeps_texts_when_nothing_can_be_learned(docs_of, odd_rows):
    import corpus_pipeline

    rows = [(i, text, None, source) for i, text, _, source in odd_rows]
    kept = corpus_pipeline.identify_language(None, docs_of(rows), "").collect()
    wanted = [(r[0], r[1]) for r in rows if lang_id.has_letter(r[1])]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(wanted, key=str)
