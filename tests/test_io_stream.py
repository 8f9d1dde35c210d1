"""Sources, sinks, plans and streams."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textwarden.plans import queries as plans
from textwarden import config
from textwarden.operators.evaluate import metrics
from textwarden.operators.moderation import moderate
from textwarden.operators.validate import split_valid, validate, validate_batch
from textwarden.sources import readers, sinks
from textwarden.streaming import online
from textwarden.util import TASKS, materialise, scratch_dir, spread

FOLDER = "/root/testdata/sf0.001"


def test_csv_upload(spark, tmp_path):
    (tmp_path / "up.csv").write_text(
        'id,Message,note\n1,"You are an idiot, ""really""",a\n2,,b\n3,NA,c\n4,"two\nlines",d\n',
        encoding="utf-8",
    )
    rows = readers.read_csv_texts(spark, str(tmp_path / "up.csv"), multi_line=True).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [
        ("1", 'You are an idiot, "really"'),
        ("4", "two\nlines"),
    ]


def test_csv_keeps_broken_rows(spark, tmp_path):
    (tmp_path / "up.csv").write_text("id,text\n1,fine\n2,too,many,cells\n")
    df = readers.read_csv(spark, str(tmp_path / "up.csv"))
    assert [r[readers.CORRUPT] for r in df.orderBy("id").collect()] == [None, "2,too,many,cells"]


def test_text_column_is_the_first_in_file_order():
    assert readers.find_text_column(["id", "Comment", "TEXT"]) == "Comment"
    with pytest.raises(ValueError, match="no text column among"):
        readers.find_text_column(["id", "body"])


def test_json_requests(spark, tmp_path):
    path = tmp_path / "single.json"
    bodies = [
        {"text": "You are an idiot", "threshold": 0.3},
        {"text": "fine", "thresholds": {"toxic": 0.01}},
        {"threshold": 1.5},
    ]
    path.write_text("\n".join(map(json.dumps, bodies)) + "\nnot json\n")
    df = readers.read_requests(spark, str(path))
    assert [r[readers.CORRUPT] for r in df.collect() if r[readers.CORRUPT]] == ["not json"]
    good, bad = split_valid(validate(df, threshold="threshold"))
    assert bad.count() == 2
    rows = moderate(good, threshold="threshold", thresholds="thresholds")
    assert {r["text"]: (r["verdict"], r["threshold_used"]) for r in rows.collect()} == {
        "You are an idiot": ("toxic", 0.3),
        "fine": ("toxic", 0.5),
    }


def test_json_batches(spark):
    body = json.dumps({"texts": ["a b c", "d e f"], "threshold": 0.0})
    df = spark.createDataFrame([(1, body), (2, '{"texts": []}')], "id int, body string")
    parsed = validate_batch(readers.parse_requests(df, "body", batch=True), threshold="threshold")
    good, bad = split_valid(parsed)
    assert good.first()["texts"] == ["a b c", "d e f"]
    assert bad.first()["errors"] == ["batch_empty"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'You are an "idiot"', "en"), (2, "two\nlines of text", "en")], "id int, text string, lang string"
    )
    rows = moderate(df)
    sinks.write_results_csv(rows, str(tmp_path / "results"))
    back = readers.read_csv(spark, str(tmp_path / "results"), multi_line=True)
    assert set(back.columns) >= {"text", "language", "verdict", "toxic_score", "threshold"}
    assert {r["text"] for r in back.collect()} == {'You are an "idiot"', "two\nlines of text"}

    sinks.write_csv(rows, str(tmp_path / "detail"))
    detail = readers.read_csv(spark, str(tmp_path / "detail"), multi_line=True).orderBy("id").collect()
    assert json.loads(detail[0]["categories"])["toxic"]["flagged"] is True

    sinks.write_moderated(rows, str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.where("verdict = 'toxic'").count() == 1
    assert (tmp_path / "table" / "verdict=clean").exists()


def test_report_sink(spark, tmp_path):
    detail = spark.createDataFrame(
        [("en", 1, 1), ("en", 0, 1), ("hi", 1, 0)], "lang string, expected int, predicted int"
    )
    sinks.write_report(metrics(detail), detail, str(tmp_path / "r"), "m", 0.5)
    document = spark.read.json(str(tmp_path / "r" / "metrics")).first()
    assert document["per_language"]["en"]["tp"] == 1 and document["overall"]["total"] == 3
    assert spark.read.json(str(tmp_path / "r" / "per_language")).count() == 2
    assert spark.read.json(str(tmp_path / "r" / "detail")).count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moderation_plan_has_no_shuffle_join_or_python(spark):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = plan_of(moderate(raw).select("doc_id", "language", "verdict"))
    for word in ("Exchange", "Join", "Python", "Sort"):
        assert word not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_scan_and_run_once(spark):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = plan_of(moderate(raw).where("verdict = 'toxic' AND lang = 'en'").select("doc_id"))
    assert "EqualTo(lang,en)" in plan
    assert plan.count("regexp_replace") == 1


@pytest.mark.parametrize("name", ["head_preview", "recent_history"])
def test_first_rows_need_no_full_sort(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_no_query_crosses_or_runs_row_python(spark):
    run = plans.registry()
    for name in sorted(run):
        plan = plan_of(run[name](spark, FOLDER))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert word not in plan, name


def test_lookup_is_a_broadcast_join(spark):
    plan = plan_of(entry.queries()["threshold_lookup"](spark, FOLDER))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_inputs_are_spread_on_request_only(spark):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert spread(raw) is raw and spread(raw, 5).rdd.getNumPartitions() == 5
    spark.conf.set(TASKS, "7")
    assert spread(raw).rdd.getNumPartitions() == 7
    spark.conf.unset(TASKS)


def test_the_registered_query_does_not_move_texts(spark):
    assert "Exchange" not in plan_of(plans.registry()["moderate"](spark, FOLDER))


def test_csv_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,You are a moron\n")
    (tmp_path / "b.csv").write_text("text,id\nfine by me,2\n")
    (tmp_path / "c.csv").write_text("id,text,lang\n3,and this,en\n")
    (tmp_path / "empty.csv").write_text("")
    rows = readers.read_csv_texts(spark, str(tmp_path / "*.csv")).orderBy("id").collect()
    assert [(r["id"], r["text"], r["lang"]) for r in rows] == [
        ("1", "You are a moron", None), ("2", "fine by me", None), ("3", "and this", "en"),
    ]
    assert all(r[readers.CORRUPT] is None for r in rows)


def test_stream_of_a_table_in_several_files(spark, tmp_path):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    raw.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.registry()["stream_moderate"](spark, str(tmp_path))
    want = plans.registry()["stream_moderate"](spark, FOLDER)
    assert got.count() == raw.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scratch_uses_the_configured_folder(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert sorted(map(tuple, materialise(df).collect())) == sorted(map(tuple, df.collect()))


def test_stream_equals_batch(spark):
    run = entry.queries()
    stream = run["stream_moderate"](spark, FOLDER)
    batch = run["moderate"](spark, FOLDER)
    assert stream.columns == batch.columns
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))


def test_moderate_stream_wants_a_stream(spark):
    with pytest.raises(ValueError):
        online.moderate_stream(spark.createDataFrame([("a",)], "text string"))


def write_requests(spark, path, rows):
    spark.createDataFrame(rows, "request_id int, ts timestamp, text string").coalesce(1).write.mode(
        "append"
    ).parquet(str(path))


def test_repeated_deliveries_and_rates(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=20 * i), "You are an idiot" if i % 3 == 0 else "fine by me") for i in range(12)]
    write_requests(spark, tmp_path / "in", rows + rows[:4])
    schema = spark.read.parquet(str(tmp_path / "in")).schema

    stream = online.read_stream(spark, str(tmp_path / "in"), schema)
    once = online.once_per_request(stream, "request_id", "ts", "12 hours")
    history = online.moderate_stream(once).select("request_id", "ts", "verdict")
    query = online.append_history(history, str(tmp_path / "out"), str(tmp_path / "c1"), available_now=True)
    query.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["request_id"] for r in kept.collect()) == list(range(12))

    verdicts = online.read_stream(spark, str(tmp_path / "out"), kept.schema)
    rates = online.verdict_rate(verdicts, "ts", "1 hour", "10 minutes")
    query = online.append_history(rates, str(tmp_path / "rates"), str(tmp_path / "c2"), available_now=True)
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "rates")).orderBy("window_start").collect()
    assert [(r["total_texts"], r["flagged_count"]) for r in found] == [(3, 1)] * 3
    assert found[0]["flagged_share"] == pytest.approx(1 / 3)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert df.columns[0] == "doc_id"


def test_null_markers_are_the_documented_set():
    assert "NA" in config.CSV_NULL_MARKERS and "" in config.CSV_NULL_MARKERS
