"""Metrics: the published 30-row result replayed, and small tables checked by hand."""

import pytest
from pyspark.sql import functions as F

from textwarden.operators import compare, evaluate, report
from textwarden.sources.readers import labelled_rows

# Language, expected class, published best score and latency of 30 texts.
PUBLISHED = """
en 1 0.9393 663.55
en 1 0.9483 26.93
en 1 0.9566 26.55
en 1 0.8788 42.39
en 1 0.8008 33.19
en 0 0.9553 34.11
en 0 0.9598 31.23
en 0 0.9583 20.63
en 0 0.9598 33.87
en 0 0.9589 25.94
hi 1 0.5601 38.22
hi 1 0.5892 29.19
hi 1 0.8762 36.08
hi 1 0.5538 21.72
hi 1 0.7328 22.4
hi 0 0.9114 19.8
hi 0 0.7268 24.77
hi 0 0.8689 29.85
hi 0 0.9319 25.27
hi 0 0.5975 25.15
ar 1 0.6523 27.59
ar 1 0.8928 25.27
ar 1 0.8338 22.58
ar 1 0.712 34.65
ar 1 0.7154 34.48
ar 0 0.882 25.37
ar 0 0.859 21.88
ar 0 0.9074 27.93
ar 0 0.9383 33.37
ar 0 0.7927 51.64
"""


@pytest.fixture(scope="module")
def published(spark):
    rows = [line.split() for line in PUBLISHED.split("\n") if line]
    typed = [(i, lang, int(e), float(s), float(ms)) for i, (lang, e, s, ms) in enumerate(rows)]
    df = spark.createDataFrame(
        typed, "id int, lang string, expected int, score double, latency_ms double"
    )
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_published_metrics_come_out(published):
    found = by(evaluate.metrics(published, latency="latency_ms"), "lang")
    latency = {"en": 93.84, "hi": 27.24, "ar": 30.48, "overall": 50.52}
    for lang, total in {"en": 10, "hi": 10, "ar": 10, "overall": 30}.items():
        row = found[lang]
        assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (total // 2, total // 2, 0, 0)
        assert row["total"] == total
        assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.5, 1.0, 0.6667)
        assert row["avg_latency_ms"] == latency[lang]


def test_published_class_means(published):
    found = by(evaluate.score_stats(published), "expected")
    assert found[1]["avg_score"] == 0.7761
    assert found[0]["avg_score"] == 0.8805


def test_published_sweep_and_rates(published):
    sweep = by(evaluate.threshold_sweep(published, [0.5, 0.96, 0.0]), "threshold")
    assert (sweep[0.0]["tp"], sweep[0.0]["fp"]) == (15, 15)
    assert (sweep[0.96]["tp"], sweep[0.96]["tn"]) == (0, 15)
    assert sweep[0.96]["precision"] == 0.0
    rates = evaluate.error_rates(published).first()
    assert (rates["fp"], rates["fpr"], rates["fn"], rates["fnr"]) == (15, 1.0, 0, 0.0)


def test_sweep_equals_filtering_at_every_threshold(published):
    grid = [0.1, 0.55, 0.7123, 0.8, 0.9598]
    for row in evaluate.threshold_sweep(published, grid, "lang").collect():
        part = published.where(F.col("lang") == row["lang"])
        want = part.withColumn("predicted", (F.col("score") >= row["threshold"]).cast("int"))
        counts = evaluate.confusion(want).first()
        assert [row[c] for c in ("tp", "fp", "fn", "tn", "total")] == list(counts)[:5]


def test_counts_add_up(published):
    row = evaluate.confusion(published).first()
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == row["total"] == 30
    assert tuple(evaluate.accuracy(published).first()) == (15, 30, 0.5)
    crosstab = by(evaluate.class_crosstab(published), "lang")
    assert (crosstab["hi"]["clean"], crosstab["hi"]["toxic"]) == (5, 5)


def test_metrics_without_positives_are_zero(spark):
    df = spark.createDataFrame([(None, 0, 0)], "lang string, expected int, predicted int")
    row = by(evaluate.metrics(df), "lang")["unknown"]
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_histogram_bins(spark):
    rows = [("a", 1, s / 100) for s in range(0, 101)] + [("b", 0, 0.25)] * 3
    df = spark.createDataFrame(rows, "lang string, expected int, score double")
    found = {(r["lang"], r["bin"]): r["n"] for r in evaluate.score_histogram(df).collect()}
    assert found[("b", 5)] == 3
    assert [found[("a", b)] for b in range(9)] == [10] * 9 and found[("a", 9)] == 11


def test_calibration_prefers_the_higher_threshold_of_equals(spark):
    rows = [("x", 1, 0.9), ("x", 1, 0.8), ("x", 0, 0.2), ("y", 1, 0.3), ("y", 0, 0.3)]
    df = spark.createDataFrame(rows, "lang string, expected int, score double")
    found = by(evaluate.calibrate(df, [0.1, 0.3, 0.5, 0.7, 0.85]), "lang")
    assert (found["x"]["threshold"], found["x"]["f1"], found["x"]["separable"]) == (0.7, 1.0, True)
    assert not found["y"]["separable"]
    used = evaluate.calibrated_thresholds(df, evaluate.calibrate(df, [0.5, 0.7]))
    assert {r["lang"]: r["threshold"] for r in used.collect()} == {"x": 0.7, "y": None}


def test_parallel_texts_and_gap(spark):
    df = spark.createDataFrame([("insult", "aa", "b", "cccc")], "cat string, en string, hi string, ar string")
    rows = evaluate.parallel_texts(df, "cat", ["en", "hi", "ar"])
    assert {(r["lang"], r["text"]) for r in rows.collect()} == {("en", "aa"), ("hi", "b"), ("ar", "cccc")}
    scored = rows.withColumn("score", F.length("text") / 10)
    row = evaluate.score_gap(scored, "cat", ["en", "hi", "ar"]).first()
    assert (row["en"], row["gap_hi"], row["gap_ar"]) == (0.2, -0.1, 0.2)


def test_errors_and_labels(published):
    assert evaluate.false_positives(published).count() == 15
    assert evaluate.false_negatives(published).count() == 0
    wrong = evaluate.misclassified(published.withColumn("text", F.lit("x" * 60))).first()
    assert (wrong["expected_label"], wrong["predicted_label"]) == ("CLEAN", "TOXIC")
    assert wrong["preview"] == "x" * 55 + "..."


def test_edge_kinds(spark):
    texts = {
        "  ": "blank", "🔥🔥🔥": "symbols", "hi": "short", "You are stuuuupid": "repeats",
        "I HATE ALL THIS": "caps", "That is really बकवास": "mixed_script", "a plain text here": "plain",
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", evaluate.edge_kind(F.col("text")).alias("kind")).collect()
    assert {r["text"]: r["kind"] for r in found} == texts


def test_ensemble_and_pairing(spark):
    schema = "id int, expected int, predicted int"
    a = spark.createDataFrame([(1, 1, 1), (2, 0, 1), (3, 1, 1), (4, 0, 1)], schema)
    b = spark.createDataFrame([(4, 0, 0), (3, 1, 0), (2, 0, 1), (1, 1, 1)], schema)
    found = by(compare.ensemble(compare.pair_results(a, b, "id")), "model")
    counts = {m: tuple(r[c] for c in ("tp", "fp", "fn", "tn")) for m, r in found.items()}
    assert counts == {"first": (2, 2, 0, 0), "second": (1, 1, 1, 1), "both": (1, 1, 1, 1), "either": (2, 2, 0, 0)}


def test_model_comparison(spark):
    rows = [(1, 1, 0.9, 1, 0.6), (1, 1, 0.5, 0, 0.1), (0, 1, 0.9, 0, 0.05), (0, 1, 0.8, 0, 0.0)]
    df = spark.createDataFrame(rows, "expected int, pa int, sa double, pb int, sb double")
    found = by(compare.compare_models(df, {"a": ("pa", "sa"), "b": ("pb", "sb")}), "metric")
    assert (found["accuracy"]["a"], found["accuracy"]["b"], found["accuracy"]["winner"]) == (0.5, 0.75, "b")
    assert found["false_negatives"]["winner"] == "a"
    assert (found["separation"]["a"], found["separation"]["b"]) == (0.0, 1.0)
    assert found["toxic_avg_score"]["winner"] == "-"


def test_append_labelled_rows(spark):
    base = labelled_rows(spark, [{"text": "a", "lang": "en", "expected": 1, "category": "insult"}])
    extra = labelled_rows(spark, [{"text": "b", "lang": "hi", "expected": 0, "category": "clean"}])
    both = compare.append_rows(base, extra.drop("category"))
    assert both.count() == 2 and both.where("category IS NULL").count() == 1


def test_attach_truth_both_ways(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id int, text string")
    truth = spark.createDataFrame([(i, i % 2) for i in range(0, 20, 3)] + [(3, 0)], "id int, expected int")

    def score(df):
        return df.withColumn("score", F.length("text"))

    results = []
    for first in (True, False):
        df = evaluate.attach_truth(texts, truth, score, "id", ["id", "score"], score_first=first)
        assert df.columns == ["id", "score", "expected"]
        results.append(sorted(map(tuple, df.collect())))
    assert results[0] == results[1] and len(results[0]) == 7


def test_undecided_rows_are_counted_apart(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, None), ("a", 0, 0)], "lang string, expected int, predicted int")
    row = by(evaluate.metrics(df), "lang")["a"]
    assert (row["tp"], row["tn"], row["total"], row["undecided"], row["accuracy"]) == (1, 1, 2, 1, 1.0)
    assert evaluate.accuracy(df).first()["accuracy"] == 1.0


def test_report(published, spark):
    metrics = evaluate.metrics(published)
    names = spark.createDataFrame([("en", "English")], "code string, name string")
    lines = by(report.report_lines(metrics, names=names), "lang")
    assert lines["en"]["line"] == "| English | 10 | 50.0% | 50.0% | 100.0% | 0.67 |"
    assert lines["overall"]["line"] == "| **Overall** | 30 | 50.0% | 50.0% | 100.0% | 0.67 |"
    document = report.report_document(metrics, "m", 0.5).first()
    assert (document["model"], document["threshold"]) == ("m", 0.5)
    assert set(document["per_language"]) == {"en", "hi", "ar"}
    assert document["overall"]["tp"] == 15 and document["per_language"]["hi"]["f1"] == 0.6667


def test_value_counts_and_recent(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c")], "id int, v string")
    assert [tuple(r) for r in evaluate.value_counts(df, "v").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert [r["id"] for r in report.recent(df, "id", 2).collect()] == [4, 3]
    assert [r["id"] for r in report.head_preview(df, "id", "v", 2).collect()] == [1, 2]


def test_measures(spark):
    df = spark.createDataFrame([(5, 148.0), (5, 152.0), (10, 253.0)], "batch_size int, total_ms double")
    found = by(evaluate.throughput(df), "batch_size")
    assert (found[5]["per_text_ms"], found[5]["texts_per_sec"], found[5]["runs"]) == (30.0, 33.33, 2)
    assert tuple(evaluate.measure_summary(df, "total_ms").first()) == (3, 184.33, 148.0, 253.0)
