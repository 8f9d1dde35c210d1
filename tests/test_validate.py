from textwarden.operators.validate import reject_summary, split_valid, validate, validate_batch


def errors(df):
    return {row["id"]: row["errors"] for row in df.collect()}


ROWS = [
    (1, "fine", None),
    (2, "", 0.5),
    (3, None, 1.0),
    (4, "x" * 5000, 0.0),
    (5, "x" * 5001, 1.5),
    (6, "   ", -0.1),
    (7, "fine", float("nan")),
]
SCHEMA = "id int, text string, threshold double"


def test_single_profile(spark):
    checked = validate(spark.createDataFrame(ROWS, SCHEMA), threshold="threshold")
    assert errors(checked) == {
        1: [],
        2: ["text_too_short"],
        3: ["missing_text"],
        4: [],
        5: ["text_too_long", "threshold_out_of_range"],
        6: ["threshold_out_of_range"],
        7: ["threshold_out_of_range"],
    }


def test_batch_profile_has_no_length_rule(spark):
    checked = validate(spark.createDataFrame(ROWS, SCHEMA), profile="batch")
    assert errors(checked) == {i: ["missing_text"] if i == 3 else [] for i in range(1, 8)}


def test_split_and_summary(spark):
    checked = validate(spark.createDataFrame(ROWS, SCHEMA), threshold="threshold")
    good, bad = split_valid(checked)
    assert sorted(row["id"] for row in good.collect()) == [1, 4]
    assert "errors" not in good.columns
    assert bad.count() == 5
    assert {row["reason"]: row["n"] for row in reject_summary(checked).collect()} == {
        "text_too_short": 1,
        "missing_text": 1,
        "text_too_long": 1,
        "threshold_out_of_range": 3,
    }


def test_batches(spark):
    rows = [
        (1, ["a"], None),
        (2, [], None),
        (3, ["a"] * 100, 0.0),
        (4, ["a"] * 101, 2.0),
        (5, None, None),
        (6, ["a", None], None),
        (7, ["", "  "], 1.0),
    ]
    df = spark.createDataFrame(rows, "id int, texts array<string>, threshold double")
    assert errors(validate_batch(df, threshold="threshold")) == {
        1: [],
        2: ["batch_empty"],
        3: [],
        4: ["batch_too_large", "threshold_out_of_range"],
        5: ["missing_texts"],
        6: ["missing_text"],
        7: [],
    }
