import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textwarden import config
from textwarden.functions import score as S
from textwarden.operators import scoring
from textwarden.util import broadcast_share, materialise, settle

TEXTS = [
    "You are an idiot and a loser, idiot!",
    "nothing to see here",
    "",
    "तुम एक बेवकूफ और बेकार इंसान हो",
    "trash " * 30,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def by_id(df, *columns):
    return {row["id"]: tuple(row[c] for c in columns) for row in df.collect()}


COLUMNS = ("score_toxic", "score_not_toxic")


def test_scores_by_hand(texts):
    found = by_id(scoring.score_columns(texts), *COLUMNS)
    assert found[1][0] == pytest.approx(1 / (1 + math.exp(3)))
    assert found[2][0] == found[1][0]
    assert found[0][0] == pytest.approx(1 / (1 + math.exp(-9)))
    assert all(0 <= score <= 1 for scores in found.values() for score in scores)


@pytest.mark.parametrize("max_tokens", [None, 5])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_join_form_equals_array_form(spark, texts, max_tokens, broadcast):
    model = config.DEFAULT_MODEL
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    joined = scoring.score_by_join(
        texts, scoring.weight_table(spark, model), dict(model.bias), key="id", max_tokens=max_tokens
    )
    want = by_id(scoring.score_columns(texts, max_tokens=max_tokens), *COLUMNS)
    got = by_id(joined, *COLUMNS)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want


def test_large_vocabulary_is_refused(texts):
    words = {f"w{i}": 1 for i in range(scoring.MAX_LITERAL_WORDS + 1)}
    with pytest.raises(ValueError):
        scoring.score_columns(texts, model=config.LinearModel({"toxic": 0}, {"toxic": words}))


def test_words_are_quoted(spark):
    model = config.LinearModel({"toxic": 0}, {"toxic": {"l'eau": 1000, "back\\slash": 1000}})
    df = spark.createDataFrame([(0, "x")], "id int, text string")
    assert scoring.score_columns(df, model=model).first()["score_toxic"] == 0.5


def test_softmax(spark):
    row = spark.range(1).select(S.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))).alias("p"))
    assert row.first()["p"] == pytest.approx([0.5, 0.5, 0.0])


def test_pick_top_and_flagged(spark):
    df = spark.createDataFrame([(0.2, 0.7)], "a double, b double")
    scores = {"toxic": F.col("a"), "Other": F.col("b")}
    row = df.select(
        S.top_label(scores).alias("top"),
        S.pick_label(F.create_map(F.lit("TOXIC"), F.col("a"))).alias("picked"),
        S.pick_label(F.create_map(F.lit("other"), F.col("a"))).alias("missing"),
    ).first()
    assert tuple(row) == ("Other", 0.2, 0.0)


def test_learned_weights(spark):
    rows = [(f"bad word{i} common", 1) for i in range(6)] + [(f"good word{i} common", 0) for i in range(6)]
    df = spark.createDataFrame(rows, "text string, expected int")
    weights = {r["tok"]: r for r in scoring.token_weights(df, min_docs=5).collect()}
    assert set(weights) == {"bad", "good", "common"}
    assert (weights["bad"]["n_toxic"], weights["bad"]["n_clean"]) == (6, 0)
    assert weights["bad"]["w_milli"] == round(1000 * 2 * math.log(13))
    assert weights["common"]["w_milli"] == 0
    table = scoring.learn_weights(df, scale=1.0)
    learned = {(r["label"], r["tok"]): r["w_milli"] for r in table.collect()}
    assert learned["toxic", "bad"] == -learned["toxic", "good"] == -learned["not_toxic", "bad"] > 0
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    scored = scoring.score_by_join(keyed, table, {"toxic": 0, "not_toxic": 0}, key="id").join(keyed, "id")
    means = {r["expected"]: r["m"] for r in scored.groupBy("expected").agg(F.avg("score_toxic").alias("m")).collect()}
    assert means[1] > 0.5 > means[0]


def test_naive_bayes_by_hand(spark):
    rows = [("bad bad day", 1), ("good day", 0), ("good", 0)]
    weights, bias = scoring.naive_bayes(spark.createDataFrame(rows, "text string, expected int"))
    found = {r["tok"]: r["w_milli"] for r in weights.where("label = 'toxic'").collect()}
    assert found == {
        "bad": round(1000 * math.log(3 / 6 / (1 / 6))),
        "day": round(1000 * math.log(2 / 6 / (2 / 6))),
        "good": round(1000 * math.log(1 / 6 / (3 / 6))),
    }
    assert bias == {"toxic": round(1000 * math.log(2 / 3)), "not_toxic": -round(1000 * math.log(2 / 3))}


def test_trained_classifier_separates(spark):
    rows = [(f"bad awful word{i}", 1) for i in range(20)] + [(f"good kind word{i}", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "text string, expected int")
    fitted = scoring.train_classifier(df, features=1 << 10)
    scored = scoring.trained_scores(df, fitted)
    assert scored.columns == ["text", "expected", "score_toxic"]
    assert scored.where((F.col("score_toxic") >= 0.5) != (F.col("expected") == 1)).count() == 0


def test_own_model_keeps_errors_to_their_rows(spark):
    def fragile():
        def predict(texts: pd.Series) -> pd.DataFrame:
            if texts.str.contains("boom").any():
                raise RuntimeError("cannot read this")
            return pd.DataFrame({"toxic": texts.str.len() / 100.0})

        return predict

    rows = [(0, "abcde"), (1, "boom"), (2, "   "), (3, None), (4, "abcdefghij")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    found = by_id(scoring.model_scores(df, fragile, ["toxic"]), "score_toxic", "error")
    assert found[0] == (0.05, None) and found[4] == (0.1, None)
    assert found[1] == (None, "RuntimeError: cannot read this")
    assert found[2] == (None, None) and found[3] == (None, None)
    failed = scoring.model_scores(df, fragile, ["toxic"]).where("error IS NOT NULL")
    assert failed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_scores_long(texts):
    rows = scoring.scores_long(scoring.score_columns(texts), "id", ["toxic", "not_toxic"])
    assert rows.columns == ["id", "label", "score"] and rows.count() == 2 * len(TEXTS)


def test_settle_keeps_rows_and_stops_filters(spark):
    df = spark.range(5).withColumn("x", F.sqrt("id"))
    settled = settle(df, "x")
    assert sorted(map(tuple, settled.collect())) == sorted(map(tuple, df.collect()))
    plan = settled.where("x > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_only_rare_words_are_shuffled(spark):
    """Of a table beyond the broadcast limit the most used words are still sent to the texts."""
    rows = [(i, f"the bad word{i} of word{i} the day" if i % 2 else f"the good word{i} of the day") for i in range(300)]
    rows += [(300, ""), (301, None), (302, "unseen"), (303, "the the the")]
    df = spark.createDataFrame(rows, "id int, text string")
    weights = {f"word{i}": i - 150 for i in range(300)} | {"the": 3, "of": -2, "bad": 70, "good": -50, "day": 1}
    seen = {f"word{i}": 1 + i % 2 for i in range(300)} | {"the": 603, "of": 300, "bad": 150, "good": 150, "day": 300}
    table = [(tok, w, seen[tok]) for tok, w in weights.items()]
    want = {i: sum(weights.get(tok, 0) for tok in (text or "").split()) for i, text in rows}
    for columns in (["tok", "w", "seen"], ["tok", "w"]):
        wide = materialise(spark.createDataFrame(table, "tok string, w bigint, seen bigint").select(*columns))
        for limit in ("10m", "2000", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            sums = scoring.weighted_sums(df, wide, {"w": F.col("w")}, ["id"])
            plan = sums._jdf.queryExecution().executedPlan().toString()
            found = {r["id"]: r["w"] for r in sums.collect()}
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert found == want
            if limit == "2000":
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_least_use_keeps_to_the_limit(spark):
    rows = [(f"w{i}", 1000 - i if i < 100 else 1) for i in range(1000)]
    wide = materialise(spark.createDataFrame(rows, "tok string, seen bigint"))
    for limit, most in (("0", 0), ("1500", 1000), ("-1", 0), ("100m", 1000)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        share, least = broadcast_share(wide), scoring._least_use(wide)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        kept = sum(seen >= least for _, seen in rows)
        assert kept <= min(most, share * len(rows))
        assert kept == len(rows) or kept <= 100
    empty = materialise(spark.createDataFrame([], "tok string, seen bigint"))
    assert scoring._least_use(empty) == 1


def test_own_model_frees_its_batches(spark):
    """A series that was asked for ``.str`` is in a cycle; the batches of a task must not pile up for that."""

    def counting():
        import weakref

        given = []

        def predict(texts: pd.Series) -> pd.DataFrame:
            alive = sum(ref() is not None for ref in given)
            given.append(weakref.ref(texts))
            return pd.DataFrame({"toxic": texts.str.len() * 0.0 + alive})

        return predict

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    df = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    found = scoring.model_scores(df, counting, ["toxic"]).agg(F.max("score_toxic")).first()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
