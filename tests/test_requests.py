"""Request bodies field by field, the one-pass split, and scorers without an answer."""

import glob
import json

import pytest

from textwarden.operators import compare, validate
from textwarden.sources import sinks
from textwarden.sources.requests import parse_typed_requests


def parsed(spark, bodies, batch=False):
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "id int, body string, errors string")
    return [row.asDict() for row in parse_typed_requests(df, "body", batch).orderBy("id").collect()]


CASES = [
    ('{"text": "a"}', []),
    ('{"text": "a", "threshold": null, "thresholds": null, "more": [1]}', []),
    ('{"text": "a", "threshold": "0.5"}', []),
    ('{"text": "a", "threshold": true}', []),
    ('{"text": "a", "threshold": 1.5}', ["threshold_out_of_range"]),
    ('{"text": "a", "threshold": "NaN"}', ["threshold_out_of_range"]),
    ('{"threshold": 0.5}', ["missing_text"]),
    ('{"text": null}', ["null_text"]),
    ('{"text": 7}', ["text_not_a_string"]),
    ('{"text": ["a"], "threshold": "high"}', ["text_not_a_string", "threshold_not_a_number"]),
    ('{"text": {"a": 1}, "threshold": {}, "thresholds": 1}',
     ["text_not_a_string", "threshold_not_a_number", "thresholds_not_an_object"]),
    ('{"text": ""}', ["text_too_short"]),
    (json.dumps({"text": "é" * 5000}), []),
    (json.dumps({"text": "é" * 5001}), ["text_too_long"]),
    ('{"text": "a", "thresholds": {"toxic": 0.1, "x": "0.2"}}', []),
    ('{"text": "a", "thresholds": {"toxic": null}}', ["thresholds_not_numbers"]),
    ('{"text": "a", "thresholds": {"toxic": 2}, "threshold": 3}', ["threshold_out_of_range"]),
    ('{"text": "a", "thresholds": {}}', []),
    ("[1]", ["bad_body"]), ("null", ["bad_body"]), ("{", ["bad_body"]), ("", ["bad_body"]), (None, ["bad_body"]),
    ('{"text": "a", "text": "b"}', ["bad_body"]), ('"text"', ["bad_body"]),
]


def test_single(spark):
    found = parsed(spark, [body for body, _ in CASES])
    assert [row["errors"] for row in found] == [errors for _, errors in CASES]
    assert (found[0]["text"], found[0]["threshold"], found[0]["thresholds"]) == ("a", None, None)
    assert (found[2]["threshold"], found[3]["threshold"], found[4]["threshold"]) == (0.5, 1.0, None)
    assert found[14]["thresholds"] == {"toxic": 0.1, "x": 0.2}
    assert found[8]["text"] is None and found[10]["text"] is None


def test_batch(spark):
    cases = [
        ('{"texts": ["a", ""]}', [], ["a", ""]),
        ('{"texts": []}', ["batch_empty"], []),
        (json.dumps({"texts": ["a"] * 101}), ["batch_too_large"], ["a"] * 101),
        ('{"texts": ["a", null]}', ["texts_not_strings"], None),
        ('{"texts": ["a", 1], "threshold": []}', ["texts_not_strings", "threshold_not_a_number"], None),
        ('{"texts": "a"}', ["texts_not_an_array"], None),
        ('{"texts": null}', ["null_texts"], None),
        ('{"text": "a"}', ["missing_texts"], None),
    ]
    found = parsed(spark, [body for body, _, _ in cases], True)
    assert [(row["errors"], row["texts"]) for row in found] == [(errors, texts) for _, errors, texts in cases]


def test_no_bodies(spark):
    assert parsed(spark, []) == []


def test_both_sides_in_one_pass(spark, tmp_path):
    """Accepted and rejected requests come out of one scan of the input."""
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, b) for i, (b, _) in enumerate(CASES)], "id int, body string").write.parquet(source)
    bodies = spark.read.parquet(source).selectExpr("id", "body", "body AS raw")
    checked = parse_typed_requests(bodies, "body")
    plan = validate.with_status(checked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    out = str(tmp_path / "out")
    sinks.write_requests(checked, out, "raw")
    assert {p.rpartition("status=")[2] for p in glob.glob(f"{out}/status=*")} == {"accepted", "rejected"}
    back = {row["id"]: row for row in spark.read.parquet(out).collect()}
    assert len(back) == len(CASES)
    for i, (body, errors) in enumerate(CASES):
        assert back[i]["status"] == ("rejected" if errors else "accepted")
        assert back[i]["raw"] == (body if errors else None)


@pytest.mark.parametrize("first, second", [((1, 1, 0, 0), (None, 1, None, 0))])
def test_undecided(spark, first, second):
    rows = [(1, a, b, 0.9, 0.8) for a, b in zip(first, second)] + [(0, a, b, 0.1, None) for a, b in zip(first, second)]
    df = spark.createDataFrame(rows, "expected int, predicted_a int, predicted_b int, s double, t double")
    found = {row["model"]: row for row in compare.ensemble(df).collect()}
    assert [(found[m]["total"], found[m]["undecided"]) for m in ("first", "second", "both", "either")] == [
        (8, 0), (4, 4), (4, 4), (4, 4),
    ]
    assert found["second"]["accuracy"] == 0.5
    models = {"a": ("predicted_a", "s"), "b": ("predicted_b", "t")}
    rates = compare.compare_models(df, models).where("metric = 'accuracy'").first()
    assert (rates["a"], rates["b"]) == (0.5, 0.5)
