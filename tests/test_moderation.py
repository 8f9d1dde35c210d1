"""Language, thresholds, verdicts on literal rows in four languages."""

import pytest
from pyspark.sql import functions as F

from textwarden import config
from textwarden.operators import language as lang_ops
from textwarden.operators.moderation import (
    batch_summary,
    display_rows,
    moderate,
    moderate_batches,
    moderate_safe,
    observe_run,
)

DETECT = [
    ("This is a normal English sentence", "en", "en"),
    ("यह एक हिंदी वाक्य है", "hi", "hi"),
    ("هذه جملة باللغة العربية", "ar", "ar"),
    ("hi", "unknown", "en"),
    ("la casa de los abuelos es una maravilla para el verano", "es", "es"),
    ("Das ist nicht der Weg und die Zeit", "de", "en"),
    ("le chat est dans une maison", "fr", "en"),
    ("não isso também é muito bom", "pt", "es"),
    ("això és el que fem amb aquest", "ca", "es"),
    ("unha cousa tamén polo mar non", "gl", "es"),
    ("मी येथे आहे आणि ते नाही", "mr", "hi"),
    ("यो किताब राम्रो छ", "ne", "hi"),
    ("یہ ایک اچھی کتاب ہے", "ur", "ar"),
    ("هذا كتاب جيد " * 20 + "ے", "ar", "ar"),  # one letter decides nothing
    ("هذا كتاب جيد " * 20 + "پ", "ar", "ar"),
    ("این کتاب خوب است گچ پژ", "fa", "ar"),
    ("12345 !!!", "unknown", "en"),
]

# text, expected verdict, language: the golden rows. One threat without any insult is missed,
# as it is by the reference's own model.
GOLDEN = [
    ("You are an absolute idiot and waste of space", "toxic", "en"),
    ("I will make sure you regret being alive", "toxic", "en"),
    ("Thank you for your thoughtful response", "clean", "en"),
    ("Great presentation today, well done!", "clean", "en"),
    ("The weather has been lovely this week", "clean", "en"),
    ("तुम एक बेवकूफ और बेकार इंसान हो", "toxic", "hi"),
    ("आपका काम बहुत अच्छा है", "clean", "hi"),
    ("आज का मौसम बहुत सुहावना है", "clean", "hi"),
    ("أنت غبي ولا تستحق الاحترام", "toxic", "ar"),
    ("شكراً لك على مساعدتك", "clean", "ar"),
    ("أتمنى لك يوماً سعيداً", "clean", "ar"),
    ("الطقس جميل اليوم", "clean", "ar"),
]
EDGE = [
    ("   ", "clean"),
    ("hi", "clean"),
    ("You are stuuuuuupid", "toxic"),
    ("YOU ARE STUPID AND WORTHLESS", "toxic"),
    ("You are such a bewakoof yaar", "toxic"),
    ("🔥🔥🔥", "clean"),
    ("Your work needs significant improvement", "clean"),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def run(spark, texts, **options):
    return moderate(frame(spark, texts), **options).orderBy("id").collect()


@pytest.fixture(scope="module")
def golden(spark):
    return run(spark, [row[0] for row in GOLDEN])


def test_detection(spark):
    found = lang_ops.detect_language(frame(spark, [row[0] for row in DETECT])).orderBy("id").collect()
    assert [(r["language_raw"], r["language"]) for r in found] == [row[1:] for row in DETECT]


def test_tied_votes_go_to_the_first_code(spark):
    found = lang_ops.detect_with_confidence(frame(spark, ["the the la la", "de"])).orderBy("id").collect()
    assert found[0]["detected_raw"] == "en"
    assert found[0]["confidence"] == round(2 / 6, 4)
    assert [c["lang"] for c in found[0]["all_candidates"]] == ["en", "es", "fr"]
    assert found[1]["detected_raw"] == "es"


def test_candidates_of_nothing(spark):
    row = lang_ops.detect_with_confidence(frame(spark, ["zzz"])).first()
    assert (row["detected_raw"], row["detected_mapped"]) == ("unknown", "en")
    assert (row["confidence"], row["all_candidates"]) == (0.0, [])


def test_candidates_show_alias_targets(spark):
    row = lang_ops.detect_with_confidence(frame(spark, ["não isso também"])).first()
    assert tuple(row["all_candidates"][0]) == ("pt", "es", 1.0)
    assert row["detected_mapped"] == "es"


def test_given_language_skips_mapping(spark):
    df = frame(spark, ["This is the one", "This is the one"]).withColumn(
        "given", F.when(F.col("id") == 0, "fr")
    )
    rows = moderate(df, language="given").orderBy("id").collect()
    assert [(r["language"], r["language_raw"]) for r in rows] == [("fr", "en"), ("en", "en")]


def test_tables(spark):
    names = {r["code"]: r["name"] for r in lang_ops.language_table(spark).collect()}
    assert {"en", "hi", "ar"} <= set(names)
    aliases = {r["alias"]: (r["maps_to"], r["target_name"]) for r in lang_ops.alias_table(spark).collect()}
    assert aliases["mr"] == ("hi", "Hindi") and len(aliases) == 7
    unknown = config.Settings(aliases={"xx": "yy"})
    assert lang_ops.alias_table(spark, unknown).first()["target_name"] == "Unknown"


def test_threshold_lookup(spark):
    codes = ["en", "hi", "ar", "es", "mr", "ur", "pt", "de", "unknown"]
    df = spark.createDataFrame([(c,) for c in codes], "lang string")
    found = {r["lang"]: r["threshold"] for r in lang_ops.lookup_threshold(df, "lang").collect()}
    assert found == {
        "en": 0.5, "hi": 0.15, "ar": 0.2, "es": 0.5, "mr": 0.15, "ur": 0.2, "pt": 0.5, "de": 0.5,
        "unknown": 0.5,
    }


def test_golden_verdicts(golden):
    wrong = [row["text"] for row, want in zip(golden, GOLDEN) if row["verdict"] != want[1]]
    assert wrong == ["I will make sure you regret being alive"]
    assert [row["language"] for row in golden] == [want[2] for want in GOLDEN]


def test_language_thresholds_catch_what_half_would_miss(golden):
    hindi = golden[5]
    assert hindi["threshold_used"] == 0.15
    assert golden[8]["threshold_used"] == 0.20
    arabic = golden[8]["categories"]["toxic"]
    assert arabic["flagged"] and arabic["score"] < 0.5


def test_edge_cases(spark):
    rows = run(spark, [text for text, _ in EDGE])
    assert [row["verdict"] for row in rows] == [want for _, want in EDGE]


def test_blank_row(spark):
    row = run(spark, ["   "])[0]
    assert row["text"] == "   "
    assert (row["language"], row["verdict"], row["categories"]) == ("unknown", "clean", {})
    assert (row["confidence"], row["threshold_used"]) == (0.0, None)
    assert row["warnings"] == [config.BLANK_WARNING]


def test_short_text_warns(spark):
    rows = run(spark, ["hi", "two words", "three words here"])
    assert [row["warnings"] for row in rows] == [
        [config.SHORT_WARNING % 1],
        [config.SHORT_WARNING % 2],
        [],
    ]


def test_original_text_comes_back(spark):
    assert run(spark, ["  You are stuuuupid  "])[0]["text"] == "  You are stuuuupid  "


def test_override(spark):
    text = "तुम बेवकूफ हो"
    assert run(spark, [text])[0]["verdict"] == "toxic"
    high = run(spark, [text], threshold=0.99)[0]
    assert (high["verdict"], high["threshold_used"]) == ("clean", 0.99)
    zero = run(spark, ["Have a wonderful day!"], threshold=0.0)[0]
    assert (zero["verdict"], zero["threshold_used"]) == ("toxic", 0.0)


def test_override_per_row_falls_back_to_the_language(spark):
    df = frame(spark, ["This is fine", "This is fine"]).withColumn("t", F.when(F.col("id") == 0, 0.01))
    rows = moderate(df, threshold="t").orderBy("id").collect()
    assert [r["threshold_used"] for r in rows] == [0.01, 0.5]
    assert [r["verdict"] for r in rows] == ["toxic", "clean"]


def test_per_category_beats_global(spark):
    row = run(spark, ["This is fine"], threshold=0.9, thresholds={"toxic": 0.01, "not_toxic": 0.95})[0]
    assert row["verdict"] == "toxic"
    assert row["threshold_used"] == 0.9
    assert not row["categories"]["not_toxic"]["flagged"]


def test_flag_is_decided_before_rounding(spark):
    # One word at logit 0 scores exactly .5, which reaches the threshold .5.
    model = config.LinearModel({"toxic": -1, "not_toxic": 1}, {"toxic": {"edge": 1}})
    rows = run(spark, ["the edge of", "the rim of"], model=model)
    assert [r["verdict"] for r in rows] == ["toxic", "clean"]
    assert rows[1]["categories"]["toxic"]["score"] == 0.4998
    near = config.LinearModel({"toxic": -0, "not_toxic": 0}, {"toxic": {"dim": -1}})
    row = run(spark, ["the dim light"], model=near, threshold=0.4998)[0]
    assert row["categories"]["toxic"]["score"] == 0.4998 and row["verdict"] == "clean"


def test_result_contract(golden):
    for row in golden:
        assert set(row["categories"]) == {"toxic", "not_toxic"}
        assert all(0 <= c["score"] <= 1 for c in row["categories"].values())
        assert row["confidence"] == max(c["score"] for c in row["categories"].values())


def test_confidence_is_the_best_of_all_labels(golden):
    arabic = golden[8]
    assert arabic["verdict"] == "toxic"
    assert arabic["confidence"] == arabic["categories"]["not_toxic"]["score"]


def test_rules(spark):
    texts = ["This is fine", "You are an idiot"]
    assert [r["verdict"] for r in run(spark, texts, rule="max_label", threshold=0.5)] == ["toxic"] * 2
    any_high = run(spark, texts, rule="any_label", threshold=0.95)
    assert [r["verdict"] for r in any_high] == ["clean", "clean"]
    with pytest.raises(ValueError):
        run(spark, texts, rule="other")


def test_token_limit_is_an_option(spark):
    text = "fine " * 600 + "idiot"
    assert run(spark, [text])[0]["verdict"] == "toxic"
    assert run(spark, [text], max_tokens=config.MAX_MODEL_TOKENS)[0]["verdict"] == "clean"


def test_safe_routing(spark):
    texts = ["hi", "you idiot", "You are an idiot", "Stupid idiot you are", "What a lovely day"]
    rows = moderate_safe(frame(spark, texts)).orderBy("id").collect()
    assert [(r["verdict"], r["certainty"]) for r in rows] == [
        ("clean", None),
        ("clean", None),
        ("needs_review", "uncertain"),
        ("toxic", "high"),
        ("clean", "high"),
    ]
    assert [r["note"] for r in rows] == [config.SHORT_NOTE] * 2 + [None] * 3
    assert rows[0]["max_score"] == 0.0


def test_batches_keep_order_and_add_up(spark):
    texts = ["You are an idiot", "Have a wonderful day!", "   ", "तुम बेवकूफ हो"]
    df = spark.createDataFrame([(7, texts)], "id int, texts array<string>")
    rows = moderate_batches(df)
    assert [r["text"] for r in rows.orderBy("position").collect()] == texts
    summary = batch_summary(rows, "id").first()
    assert tuple(summary) == (7, 4, 2, 2, 0)
    assert summary["flagged_count"] + summary["clean_count"] == summary["total_texts"]


def test_run_counts_come_with_the_write(spark):
    rows = moderate(frame(spark, ["You are an idiot", "Have a wonderful day!", "   "]))
    observed, observation = observe_run(rows)
    observed.write.format("noop").mode("overwrite").save()
    assert observation.get == {
        "total_texts": 3, "flagged_count": 1, "clean_count": 2, "skipped_count": 1, "undecided_count": 0,
    }


def test_display_rows(spark):
    rows = display_rows(moderate(frame(spark, ["x" * 81, "   "]))).collect()
    assert (rows[0]["text"], rows[0]["threshold"]) == ("x" * 80 + "...", "0.5")
    assert (rows[1]["toxic_score"], rows[1]["threshold"]) == (0.0, "N/A")


def test_settings_override():
    settings = config.DEFAULT_SETTINGS.override(
        {"THRESHOLD_AR": "0.10", "threshold_default": "0.4", "THRESHOLD_XX": "0.9", "PATH": "/bin"}
    )
    assert settings.thresholds == {"en": 0.5, "hi": 0.15, "ar": 0.10, "es": 0.5}
    assert settings.default_threshold == 0.4


def test_settings_reach_the_verdict(spark):
    settings = config.DEFAULT_SETTINGS.override({"threshold_ar": 0.3})
    row = run(spark, ["أنت غبي ولا تستحق الاحترام"], settings=settings)[0]
    assert (row["threshold_used"], row["verdict"]) == (0.3, "clean")


def test_learned_profile_detects(spark):
    rows = [(f"der hund und {w} katze", "aa") for w in ("die", "das", "ein")]
    rows += [(f"the dog and {w} cat und", "bb") for w in ("a", "this", "one")]
    learned = lang_ops.learn_profile(spark.createDataFrame(rows, "text string, lang string"), top=5)
    profile = {}
    for r in learned.orderBy("lang", "rank").collect():
        profile[r["lang"]] = (*profile.get(r["lang"], ()), r["tok"])
    assert profile == {"aa": ("der", "hund", "katze", "das"), "bb": ("and", "cat", "dog", "the")}
    found = lang_ops.detect_language(frame(spark, ["der hund", "the cat and dog"]), profile=profile)
    assert [r["language_raw"] for r in found.orderBy("id").collect()] == ["aa", "bb"]


def test_learned_grams_tell_languages(spark):
    rows = [(1, "la casa de la niña", "es"), (2, "el perro y la casa", "es"), (3, "the house of the dog", "en")]
    df = spark.createDataFrame([*rows, (4, "la casa", None), (5, "1 ! 2", None), (6, None, None)], "k int, text string, lang string")
    grams = lang_ops.learn_grams(df)
    found = {r["k"]: r for r in lang_ops.detect_learned(df, grams, "k").collect()}
    assert [found[k]["detected"] for k in range(1, 7)] == ["es", "es", "en", "es", "unknown", "unknown"]
    assert found[6]["confidence"] == 0.0 and found[3]["confidence"] > 0.9
    assert [c["lang"] for c in found[1]["all_candidates"]] == ["es", "en"]


def test_min_docs_counts_texts(spark):
    df = spark.createDataFrame([("many many many", "en"), ("few", "en"), ("few", "en")], "text string, lang string")
    assert [r["tok"] for r in lang_ops.learn_profile(df, min_docs=2).collect()] == ["few"]


def test_own_scores_and_undecided_rows(spark):
    rows = [(1, "a fine text here", 0.9, 0.1, None), (2, "a fine text here", 0.1, 0.95, None),
            (3, None, 0.9, 0.1, None), (4, "it failed on this", None, None, "boom"), (5, "no score for this", None, None, None),
            (6, "  ", None, None, None)]
    df = spark.createDataFrame(rows, "k int, text string, t double, n double, error string")
    moderated = moderate(df, scores={"toxic": "t", "not_toxic": "n"})
    assert moderated.columns.count("error") == 1
    found = {r["k"]: r for r in moderated.collect()}
    assert [(found[k]["verdict"], found[k]["confidence"], found[k]["error"]) for k in range(1, 7)] == [
        ("toxic", 0.9, None), ("clean", 0.95, None), (None, None, "missing_text"),
        (None, None, "boom"), (None, None, "missing_score"), ("clean", 0.0, None),
    ]
    assert found[1]["categories"]["toxic"]["flagged"] and found[3]["categories"] is None
    counts = batch_summary(moderated).first()
    assert tuple(counts) == (6, 1, 2, 3)
    plain = {r["k"]: r for r in moderate(df.select("k", "text")).collect()}
    assert plain[3]["verdict"] is None and plain[3]["error"] == "missing_text" and plain[1]["verdict"] == "clean"


def test_learned_languages_under_any_broadcast(spark):
    """The texts are read once to learn from, and words beyond the broadcast limit change nothing."""
    rows = [(i, f"the thing word{i} and", "en") for i in range(60)] + [(60 + i, f"der ding wort{i} und", "de") for i in range(60)]
    df = spark.createDataFrame([*rows, (120, "", "en"), (121, None, None)], "k int, text string, lang string")
    grams = lang_ops.learn_grams(df)
    assert "split(" not in grams._jdf.queryExecution().executedPlan().toString()
    found = []
    for limit in ("10m", "1500", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        found.append(sorted(map(str, lang_ops.detect_learned(df, grams, "k").collect())))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] == found[2] and len(found[0]) == 122
    told = {r["k"]: r["detected"] for r in lang_ops.detect_learned(df, grams, "k").collect()}
    assert all(told[k] == lang for k, _, lang in rows) and told[120] == told[121] == "unknown"
