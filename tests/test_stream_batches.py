"""Streams written batch by batch, and histories kept as state."""

import random

from textwarden.operators import moderation, scoring
from textwarden.streaming import online

SCHEMA = "session string, turn bigint, text string"


def run(query):
    query.awaitTermination()


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write = online.batch_writer(path, moderation.moderate, ["verdict"])
    first = spark.createDataFrame([(1, "you stupid idiot"), (2, "a kind word for you")], "k int, text string")
    second = spark.createDataFrame([(3, "what an idiot you are")], "k int, text string")
    schema = moderation.moderate(first).schema

    def rows():
        return sorted((r["batch"], r["k"], r["verdict"]) for r in online.read_batches(spark, path, schema).collect())

    write(first, 0)
    write(second, 1)
    once = rows()
    assert [k for _, k, _ in once] == [1, 2, 3] and {v for _, _, v in once} == {"toxic", "clean"}
    write(first, 0)
    write(second, 1)
    assert rows() == once
    # a batch delivered again with fewer rows leaves none of its old folders behind
    write(first.where("k = 2"), 0)
    assert [k for _, k, _ in rows()] == [2, 3]


def test_restarted_stream_goes_on(spark, tmp_path):
    """A stopped query goes on behind its last batch; learned weights are joined in every batch."""
    source, path, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    weights = spark.createDataFrame([("toxic", "idiot", 4000)], "label string, tok string, w_milli int")

    def scored(batch):
        return scoring.score_by_join(batch, weights, {"toxic": -2000}, key="k")

    want = {}
    for i in range(3):
        part = spark.createDataFrame([(i, "idiot " * i), (10 + i, None)], "k int, text string")
        part.write.mode("append").parquet(source)
        want |= {r["k"]: r["score_toxic"] for r in scored(part).collect()}
        stream = online.read_stream(spark, source, part.schema)
        run(online.write_batches(stream, path, state, scored, available_now=True))
    found = online.read_batches(spark, path, scored(part).schema).collect()
    assert len(found) == 6 and {r["k"]: r["score_toxic"] for r in found} == want
    assert len({r["batch"] for r in found}) == 3


def test_history_over_several_batches(spark, tmp_path):
    """State holds the newest rows of each session only, and goes on over restarts."""
    rng = random.Random(9)
    source, path, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    seen = []
    for i in range(3):
        rows = [("hot", rng.choice([None, rng.randrange(500)]), f"t{rng.randrange(9)}") for _ in range(200)]
        rows += [(f"s{rng.randrange(5)}", rng.randrange(50), rng.choice(["a", None, "b"])) for _ in range(20)]
        rows += [(None, 1, "no session")] * (i + 1)
        seen += rows
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = online.read_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=2)
        history = online.session_history(stream, "session", "turn", "text", keep=4)
        writer = history.writeStream.foreachBatch(online.batch_writer(path)).outputMode("update")
        query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
        run(query)
        held = sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
        assert held <= 3 * 4 * 7  # at most four rows of seven sessions, with the store's own entries
    batches = online.read_batches(spark, path, history.schema)
    found = {}
    for row in online.latest_history(batches, "session").orderBy("rank").collect():
        found.setdefault(row["session"], []).append((row["turn"], row["text"]))
    place = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    want = {}
    for session, turn, text in seen:
        want.setdefault(session, []).append((turn, text))
    assert found == {session: sorted(rows, key=place, reverse=True)[:4] for session, rows in want.items()}
