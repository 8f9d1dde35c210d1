"""Exact calibration and out-of-fold scores against plain Python."""

import math
import random
from collections import Counter, defaultdict

from textwarden.operators import calibrate, scoring
from textwarden.util import fits_broadcast, materialise


def best_cut(rows):
    """``(threshold, tp, fp, fn, tn, f1, separable)`` by trying every score."""
    best, separable = None, False
    for cut in {s for s, _ in rows}:
        tp = sum(s >= cut and e == 1 for s, e in rows)
        fp = sum(s >= cut and e == 0 for s, e in rows)
        fn, tn = sum(e == 1 for _, e in rows) - tp, sum(e == 0 for _, e in rows) - fp
        f1 = 2.0 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        gain = (tp / (tp + fn) if tp + fn else 0) - (fp / (fp + tn) if fp + tn else 0)
        separable |= gain > 0
        if best is None or (f1, cut) > best[:2]:
            best = f1, cut, tp, fp, fn, tn
    return (*best[1:], best[0], separable)


def test_every_score_is_a_cut(spark):
    rng = random.Random(4)
    rows = [("en", rng.choice([rng.random(), round(rng.random(), 1)]), rng.randrange(2)) for _ in range(3000)]
    rows += [("de", 0.5, i % 2) for i in range(40)] + [("fr", i / 10, 0) for i in range(5)] + [(None, 0.3, 1), ("es", 0.1, 1)]
    odd = [("en", None, 1), ("en", float("nan"), 1), ("en", 0.2, None), ("xx", None, 1)]
    df = spark.createDataFrame(rows + odd, "lang string, score double, expected int").repartition(5)
    found = {row[0]: tuple(row)[1:] for row in calibrate.calibrate_exact(df).collect()}
    groups = defaultdict(list)
    for lang, score, expected in rows:
        groups[lang or "unknown"].append((score, expected))
    assert found == {lang: best_cut(group) for lang, group in groups.items()}


def test_one_group_lies_in_many_ranges(spark):
    """No task sorts a whole group: windows over rows are cut by range."""
    df = spark.range(20_000).selectExpr("'en' AS lang", "id / 20000 AS score", "cast(id % 3 = 0 AS int) AS expected")
    cuts = calibrate.exact_cuts(df)
    assert cuts.count() == 20_000
    plan = cuts._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_rows = [line for line in windows if "threshold" in line]
    assert over_rows and all("_range" in line for line in over_rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "lang string, score double, expected int")
    assert calibrate.calibrate_exact(df).collect() == []


WORDS = "you are kind fool bad good day stupid nice trash weather rain".split()


def fold_scores(rows, folds):
    """Naive Bayes fitted anew for every fold."""
    out = {}
    for fold in range(folds):
        counts, texts = {0: Counter(), 1: Counter()}, Counter()
        for _, text, expected, own in rows:
            if own != fold:
                texts[expected] += 1
                counts[expected].update((text or "").split())
        seen = set(counts[0]) | set(counts[1])
        total = {c: sum(counts[c].values()) + len(seen) for c in (0, 1)}
        half_up = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
        weight = {
            t: half_up(1000 * math.log(((counts[1][t] + 1.0) / total[1]) / ((counts[0][t] + 1.0) / total[0]))) for t in seen
        }
        bias = half_up(1000 * math.log((texts[1] + 1.0) / (texts[0] + 1.0)))
        for key, text, _, own in rows:
            if own == fold:
                x = bias + sum(weight.get(t, 0) for t in (text or "").split())
                out[key] = 1 / (1 + math.exp(-x / 1000))
    return out


def test_out_of_fold(spark):
    rng = random.Random(8)
    rows = [
        (i, " ".join(rng.choices(WORDS, k=rng.randrange(12))) + f" only{i}", rng.randrange(2), rng.randrange(3))
        for i in range(90)
    ] + [(200, None, 1, 0), (201, "", 0, 1)]
    df = spark.createDataFrame(rows, "k int, text string, expected int, fold int").repartition(4)
    want = fold_scores(rows, 3)
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = {row["k"]: row["score"] for row in scoring.oof_scores(df, "fold", 3, ["k"]).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert found.keys() == want.keys()
        assert all(math.isclose(found[k], want[k], rel_tol=1e-12) for k in want)


def test_a_fold_without_others(spark):
    """All rows in one fold: nothing is learned for it, and no score leans either way."""
    df = spark.createDataFrame([(1, "a b", 1, 0), (2, "c", 0, 0)], "k int, text string, expected int, fold int")
    assert [row["score"] for row in scoring.oof_scores(df, "fold", 2, ["k"]).collect()] == [0.5, 0.5]


def test_small_weights_move_no_tokens(spark):
    """With few weights the only shuffle is one of sums by text."""
    df = spark.createDataFrame([(1, "kind fool"), (2, None)], "k int, text string")
    weights = spark.createDataFrame([("toxic", "fool", 3000)], "label string, tok string, w_milli int")
    scored = scoring.score_by_join(df, weights, {"toxic": -2000}, key="k")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and plan.count("Aggregate") == 1
    assert {r["k"]: round(r["score_toxic"], 4) for r in scored.collect()} == {1: 0.7311, 2: 0.1192}
    assert fits_broadcast(materialise(df))
