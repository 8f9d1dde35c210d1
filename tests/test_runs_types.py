"""Inferred column types, and the table of the library's own runs."""

import datetime

from textwarden.operators import evaluate, moderation, runs
from textwarden.sources import readers, sinks
from textwarden.streaming import online


def kinds(spark, *columns):
    rows = list(zip(*columns))
    names = [f"c{i}" for i in range(len(columns))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).repartition(3)
    return [readers.infer_types(df)[n] for n in names]


def test_lattice(spark):
    found = kinds(
        spark,
        ["1", " -2", None], ["1", "2.5", "1e3"], ["true", "False", None], ["2024-01-02", "2024-1-3", None],
        ["2024-01-02", "2024-01-02 03:04:05", None], ["1", "true", None], ["2024", "2025", "7"], ["", "1", "2"],
        [None, None, None], ["99999999999999999999", "1", "2"], ["yes", "no", None], ["2024-01-02", "x", "1"],
    )
    assert found == [
        "bigint", "double", "boolean", "date", "timestamp", "string", "bigint", "string", "string", "double", "boolean", "string",
    ]


def test_files_that_disagree_meet_in_the_common_type(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.createDataFrame([(1, "1", "x")], "id int, n string, text string"), path)
    sinks.write_csv(spark.createDataFrame([("y, \"z\"", "2.5", 2, None)], "text string, n string, id int, more string"), path, "append")
    df = readers.typed_columns(readers.read_csv(spark, path).drop("_corrupt_record"))
    types = {"id": "bigint", "n": "double", "text": "string", "more": "string"}
    assert dict(df.dtypes) == types
    assert sorted((r["id"], r["n"], r["text"]) for r in df.collect()) == [(1, 1.0, "x"), (2, 2.5, 'y, "z"')]
    assert readers.infer_types(df.select("text").where("false")) == {"text": "string"}


def test_runs_are_recorded(spark, tmp_path):
    path, out = str(tmp_path / "runs"), str(tmp_path / "out")
    texts = spark.createDataFrame([("you idiot",), ("  ",), (None,), ("a kind word",)], "text string")
    for _ in range(2):
        counters = runs.recorded(moderation.moderate(texts), lambda df: df.write.mode("append").parquet(out), path)
    assert counters["total_texts"] == 4 and counters["undecided_count"] == 1 and counters["skipped_count"] == 1
    found = runs.read_runs(spark, path).collect()
    assert [r["batch_size"] for r in found] == [4, 4] and all(r["total_ms"] > 0 for r in found)
    assert all(datetime.datetime.now() - r["finished"] < datetime.timedelta(minutes=5) for r in found)
    speed = evaluate.throughput(runs.read_runs(spark, path)).first()
    assert (speed["batch_size"], speed["runs"]) == (4, 2) and speed["texts_per_sec"] > 0


def test_batches_of_a_stream_are_recorded(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "runs")
    listener = runs.RunListener(spark, path, "watched")
    spark.streams.addListener(listener)
    try:
        for i in range(2):
            spark.createDataFrame([(f"text number {i}",)] * (i + 1), "text string").coalesce(1).write.mode("append").parquet(source)
            stream = online.read_stream(spark, source, spark.read.parquet(source).schema)
            observed = runs.observe_stream(online.moderate_stream(stream), "watched")
            query = online.append_history(observed, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
            query.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    found = runs.read_runs(spark, path)
    assert sorted(r["batch_size"] for r in found.collect()) == [1, 2]
