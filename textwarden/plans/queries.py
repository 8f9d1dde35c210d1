"""The registered queries: each takes ``(spark, folder)`` and returns a DataFrame.

All of them run over whole tables and whole texts. Three inputs recur: the documents, the
*messages* (the sentences of all documents, among them blank and very short ones), and the
*evaluated* rows (labelled documents with their score and prediction).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import config
from textwarden.functions import score as S
from textwarden.functions import text as T
from textwarden.operators import calibrate, compare, evaluate, language, moderation, report, runs, scoring, validate
from textwarden.sources import sinks
from textwarden.sources.readers import (
    parse_requests,
    read_csv,
    read_csv_texts,
    read_table,
    read_texts,
    text_column,
    typed_columns,
)
from textwarden.sources.requests import parse_typed_requests
from textwarden.streaming import online
from textwarden.util import materialise, scratch_dir, spread

SENTENCE_END = r"[.!?\n]"
DETECTED = ("en", "de", "es", "fr", "pt", "ca", "gl", config.UNKNOWN_LANGUAGE)
FINE_GRID = tuple(round(0.05 * step, 2) for step in range(1, 20))
BYO_WORDS = "trash|clown|idiot|scum|worthless|moron|pathetic|loser|stupid|disgusting"


# --- Inputs ---------------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_texts(spark, folder, "documents").select("doc_id", "text", "lang")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.posexplode(F.split("text", SENTENCE_END)).alias("pos", "text")
    return documents(spark, folder).select("doc_id", parts).withColumn("pos", F.col("pos").cast("bigint"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("expected"))


def _predict(df: DataFrame) -> DataFrame:
    """Moderate once and decide twice: by the toxic label and by the best of all labels."""
    moderated = moderation.moderate(df, keep_scores=True)
    best = F.coalesce(F.greatest("score_toxic", "score_not_toxic"), F.lit(0.0))
    return moderated.withColumns(
        {
            "predicted": (F.col("verdict") == "toxic").cast("int"),
            "score": F.coalesce("score_toxic", F.lit(0.0)),
            "predicted_max": F.coalesce(best >= F.col("threshold_used"), F.lit(False)).cast("int"),
            "score_max": best,
            "preview": T.preview(F.col("text"), 55),
            "latency_ms": F.char_length("text") / 100.0,
        }
    )


def evaluated(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Labelled documents with prediction and score, plus the columns asked for."""
    return evaluate.attach_truth(
        read_table(spark, folder, "documents").select("doc_id", "text", "lang"),
        labelled(spark, folder),
        lambda df: _predict(spread(df)),
        "doc_id",
        ["doc_id", "lang", "predicted", "score", *keep],
    )


def by_max_label(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents, decided by the best of all labels."""
    rows = evaluated(spark, folder, "predicted_max", "score_max")
    return rows.drop("predicted", "score").withColumnsRenamed(
        {"predicted_max": "predicted", "score_max": "score"}
    )


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with their text, written out: learning reads them more than once,
    and should not search all documents for them each time."""
    return materialise(
        evaluate.attach_truth(
            read_table(spark, folder, "documents").select("doc_id", "text", "lang"),
            labelled(spark, folder),
            spread,
            "doc_id",
            ["doc_id", "lang", "text"],
        )
    )


LEARNED_BIAS = {"toxic": -2000, "not_toxic": 2000}
HELD_OUT = "substring(md5(cast(doc_id AS string)), 1, 1) IN ('0', '1', '2', '3')"
"""A quarter of the documents, told by a hash of their key, that nothing is fitted on."""


def learned_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents under a keyword model learned from the same labels (a fit, not a test)."""
    texts = labelled_texts(spark, folder)
    weights = scoring.learn_weights(texts, min_docs=5)
    scored = scoring.score_by_join(texts, weights, LEARNED_BIAS, key="doc_id")
    return texts.select("doc_id", "lang", "expected").join(scored, "doc_id").select(
        "doc_id", "lang", "expected", F.col("score_toxic").alias("score")
    )


def bayes_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All documents under naive Bayes fitted on the labelled ones that are not held out."""
    weights, bias = scoring.naive_bayes(labelled_texts(spark, folder).where(f"NOT {HELD_OUT}"))
    return scoring.score_by_join(documents(spark, folder), weights, bias, key="doc_id")


def _joined(values: str | Column) -> Column:
    return F.array_join(values, ",")


# --- Sources and validation -----------------------------------------------------------


def q_text_column(spark: SparkSession, folder: str) -> DataFrame:
    uploaded = read_table(spark, folder, "conversations").withColumnRenamed("text", "Message")
    return text_column(uploaded, null_markers=config.CSV_NULL_MARKERS)


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    """A batch request per document: its lines, with a threshold of its own for some."""
    return documents(spark, folder).select(
        "doc_id",
        F.split("text", "\n").alias("texts"),
        F.when(F.col("lang") == "es", 0.04).alias("threshold"),
    )


def q_batch_requests(spark: SparkSession, folder: str) -> DataFrame:
    bodies = _batches(spark, folder).select(
        "doc_id", F.to_json(F.struct("texts", "threshold")).alias("body")
    )
    requests = validate.validate_batch(parse_requests(bodies, "body", batch=True), threshold="threshold")
    accepted, _ = validate.split_valid(requests)
    rows = moderation.moderate_batches(accepted, threshold="threshold")
    return rows.select(
        "doc_id",
        F.col("position").cast("bigint").alias("position"),
        "language",
        "verdict",
        "confidence",
        "threshold_used",
        _joined("warnings").alias("warnings"),
    )


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Single requests, some without a text, some with a threshold, some of them out of range."""
    return read_table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("source") != "src0", F.col("text")).alias("text"),
        F.when(F.col("lang") != "en", F.col("n_chars") / 10000).alias("threshold"),
    )


def q_validate(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate.validate(_requests(spark, folder), threshold="threshold")
    return checked.select("doc_id", _joined("errors").alias("errors"))


def q_validate_batch(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate.validate_batch(_batches(spark, folder), threshold="threshold")
    return checked.select(
        "doc_id", F.size("texts").cast("bigint").alias("n_texts"), _joined("errors").alias("errors")
    )


def _odd_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON body per document, most of them with a field that is absent, null or of a wrong type."""
    text, number = F.col("text"), F.col("n_chars") / 10000
    label = F.create_map(F.lit("toxic"), number)
    bodies = [
        F.to_json(F.struct("text", number.alias("threshold"))),
        F.to_json(F.struct(number.alias("threshold"))),
        F.concat(F.lit('{"text": null, "threshold": '), number.cast("decimal(12,4)").cast("string"), F.lit("}")),
        F.to_json(F.struct(F.struct("text").alias("text"))),
        F.to_json(F.struct(F.col("n_chars").alias("text"), F.lit("high").alias("threshold"))),
        F.to_json(F.struct("text", number.cast("decimal(12,4)").cast("string").alias("threshold"))),
        F.to_json(F.struct("text", F.array(number).alias("threshold"), F.array("lang").alias("thresholds"))),
        F.to_json(F.struct("text", label.alias("thresholds"))),
        F.to_json(F.struct("text", F.create_map(F.lit("toxic"), F.col("lang")).alias("thresholds"))),
        F.to_json(F.array("text")),
        F.concat(F.lit('{"text": '), F.col("source")),
    ]
    kinds = F.when(F.lit(False), F.lit(""))
    for i, body in enumerate(bodies):
        kinds = kinds.when(F.col("doc_id") % len(bodies) == i, body)
    return read_table(spark, folder, "documents").select("doc_id", kinds.alias("body"))


def q_typed_requests(spark: SparkSession, folder: str) -> DataFrame:
    found = parse_typed_requests(_odd_bodies(spark, folder), "body")
    return found.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_text"),
        F.round("threshold", 4).alias("threshold"),
        F.round(F.col("thresholds")["toxic"], 4).alias("toxic_threshold"),
        _joined("errors").alias("errors"),
    )


def q_typed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A batch body per conversation, by its first turn's length with null, numeric or no texts."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    batches = read_table(spark, folder, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    kind = F.col("conv_id") % 5
    texts = F.col("turns.text")
    body = (
        F.when(kind == 0, F.to_json(F.struct(texts.alias("texts"))))
        .when(kind == 1, F.lit('{"texts": ["one", null]}'))
        .when(kind == 2, F.to_json(F.struct(F.col("turns.turn").alias("texts"))))
        .when(kind == 3, F.to_json(F.struct(F.element_at(texts, 1).alias("texts"))))
        .otherwise(F.lit('{"texts": [], "threshold": false}'))
    )
    found = parse_typed_requests(batches.select("conv_id", body.alias("body")), "body", batch=True)
    return found.select(
        "conv_id", F.when(F.col("texts").isNotNull(), F.size("texts")).cast("bigint").alias("n_texts"),
        "threshold", _joined("errors").alias("errors"),
    )


def q_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The same requests written once, accepted and rejected apart, and both sides read back."""
    path = scratch_dir(spark)
    bodies = _odd_bodies(spark, folder).withColumn("raw", F.col("body"))
    sinks.write_requests(parse_typed_requests(bodies, "body"), path, "raw")
    back = spark.read.parquet(path)
    return back.select(
        "doc_id", "status", _joined("errors").alias("errors"), (F.length("raw") > 0).alias("has_raw"),
        F.char_length("text").cast("bigint").alias("n_text"),
    )


def q_reject_summary(spark: SparkSession, folder: str) -> DataFrame:
    return validate.reject_summary(validate.validate(_requests(spark, folder), threshold="threshold"))


# --- Cleaning -------------------------------------------------------------------------


def q_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).select(
        "doc_id",
        "pos",
        T.sanitise(F.col("text")).alias("cleaned"),
        _joined(T.warnings(T.strip(F.col("text")))).alias("warnings"),
    )


def q_blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = moderation.moderate(messages(spark, folder).where(T.is_blank(F.col("text"))))
    return rows.select(
        "doc_id",
        "pos",
        "language",
        "verdict",
        F.size("categories").cast("bigint").alias("n_categories"),
        "confidence",
        "threshold_used",
        _joined("warnings").alias("warnings"),
    )


def q_word_stats(spark: SparkSession, folder: str) -> DataFrame:
    words = T.word_count(F.col("text")).cast("bigint")
    return documents(spark, folder).select("doc_id", words.alias("n_words"))


def q_short_text(spark: SparkSession, folder: str) -> DataFrame:
    warned = messages(spark, folder).withColumn("warning", T.short_warning(T.strip(F.col("text"))))
    return warned.where(F.col("warning").isNotNull()).select("doc_id", "pos", "warning")


def q_collapse_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return (
        documents(spark, folder)
        .withColumn("short", T.collapse_repeats(F.col("text")))
        .select(
            "doc_id",
            F.md5("short").alias("digest"),
            (F.char_length("text") - F.char_length("short")).cast("bigint").alias("removed"),
        )
    )


def q_normalise_strict(spark: SparkSession, folder: str) -> DataFrame:
    return (
        documents(spark, folder)
        .withColumn("plain", T.normalise_strict(F.col("text")))
        .select(
            "doc_id",
            F.md5("plain").alias("digest"),
            F.char_length("plain").cast("bigint").alias("length"),
        )
    )


def q_preview(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id", *[T.preview(text, n).alias(f"first_{n}") for n in (80, 60, 55, 48, 40)]
    )


# --- Language -------------------------------------------------------------------------


def q_lang_raw(spark: SparkSession, folder: str) -> DataFrame:
    return language.detect_language(documents(spark, folder)).select("doc_id", "language_raw")


def q_lang_mapped(spark: SparkSession, folder: str) -> DataFrame:
    return language.detect_language(documents(spark, folder)).select("doc_id", "language")


def q_lang_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = language.detect_with_confidence(documents(spark, folder))
    return found.select(
        "doc_id",
        "detected_raw",
        "detected_mapped",
        "confidence",
        F.array_join(
            F.transform("all_candidates", lambda c: F.concat_ws(">", c["lang"], c["mapped_to"])), ","
        ).alias("candidates"),
    )


def q_dim_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Supported languages with the number of documents reported in each."""
    found = language.detect_language(documents(spark, folder))
    counts = found.groupBy(F.col("language").alias("code")).agg(F.count("*").alias("n"))
    return (
        language.language_table(spark)
        .join(counts, "code", "left")
        .select("code", "name", F.coalesce("n", F.lit(0)).alias("n_docs"))
    )


def q_dim_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases with the number of documents reported under their target language."""
    found = language.detect_language(documents(spark, folder))
    counts = found.groupBy(F.col("language").alias("maps_to")).agg(F.count("*").alias("n"))
    return (
        language.alias_table(spark)
        .join(counts, "maps_to", "left")
        .select("alias", "maps_to", "target_name", F.coalesce("n", F.lit(0)).alias("n_target_docs"))
    )


def q_lang_override(spark: SparkSession, folder: str) -> DataFrame:
    given = documents(spark, folder).withColumn("given", F.when(F.col("lang") == "fr", F.col("lang")))
    found = language.detect_language(given, given="given")
    return found.select("doc_id", "language_raw", "language")


def q_lang_profile(spark: SparkSession, folder: str) -> DataFrame:
    return language.learn_profile(documents(spark, folder), top=15)


def learned_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, by n-grams of those that are not held out."""
    texts = documents(spark, folder)
    return language.detect_learned(texts, language.learn_grams(texts.where(f"NOT {HELD_OUT}")), "doc_id")


def q_lang_learned(spark: SparkSession, folder: str) -> DataFrame:
    return learned_languages(spark, folder).select("doc_id", "detected", "confidence")


def q_lang_learned_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Declared against learned language, on the documents held out."""
    declared = read_table(spark, folder, "documents").select("doc_id", "lang").where(HELD_OUT)
    found = declared.join(learned_languages(spark, folder), "doc_id")
    return found.groupBy("lang", "detected").agg(F.count("*").alias("n"))


def q_lang_confusion(spark: SparkSession, folder: str) -> DataFrame:
    found = language.detect_language(documents(spark, folder))
    return language.confusion_by_language(found, "lang", "language_raw", DETECTED)


# --- Thresholds and scores ------------------------------------------------------------


def q_threshold_lookup(spark: SparkSession, folder: str) -> DataFrame:
    declared = read_table(spark, folder, "documents").select("doc_id", "lang")
    return language.lookup_threshold(declared, "lang").select("doc_id", "lang", "threshold")


def q_threshold_override(spark: SparkSession, folder: str) -> DataFrame:
    own = F.when(F.col("lang") == "de", 0.0).when(F.col("lang") == "en", 0.99)
    rows = moderation.moderate(documents(spark, folder), threshold=own)
    return rows.select("doc_id", "threshold_used", "verdict")


def q_threshold_per_category(spark: SparkSession, folder: str) -> DataFrame:
    own = F.when(F.col("lang") == "fr", F.create_map(F.lit("toxic"), F.lit(0.04))).when(
        F.col("lang") == "en", F.create_map(F.lit("not_toxic"), F.lit(0.95))
    )
    rows = moderation.moderate(documents(spark, folder), threshold=0.6, thresholds=own)
    return rows.select("doc_id", "verdict", *_flat_categories())


def _flat_categories() -> list[Column]:
    return [
        F.col("categories")[label][part].alias(f"{label}_{part}")
        for label in ("toxic", "not_toxic")
        for part in ("score", "flagged")
    ]


def q_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the whole text, and what a model limited to 512 of them would see."""
    limit = config.MAX_MODEL_TOKENS
    return (
        documents(spark, folder)
        .withColumn("all", T.tokens(F.col("text")))
        .select(
            "doc_id",
            F.size("all").cast("bigint").alias("n_tokens"),
            F.md5(F.array_join("all", " ")).alias("digest"),
            F.md5(F.array_join(F.slice("all", 1, limit), " ")).alias("cut_digest"),
            (F.size("all") > limit).alias("truncated"),
        )
    )


def q_tokens_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.token_stats(documents(spark, folder), "lang")


def _rounded_scores(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", *[F.round(f"score_{label}", 6).alias(label) for label in ("toxic", "not_toxic")]
    )


def q_score_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_scores(scoring.score_columns(documents(spark, folder)))


def q_score_join(spark: SparkSession, folder: str) -> DataFrame:
    model = config.DEFAULT_MODEL
    weights = scoring.weight_table(spark, model)
    texts = documents(spark, folder)
    return _rounded_scores(scoring.score_by_join(texts, weights, dict(model.bias), key="doc_id"))


def q_softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    logits = scoring.score_columns(
        documents(spark, folder), prefix="logit_", activation=lambda logit: logit
    )
    shares = logits.withColumn("shares", S.softmax(F.array("logit_toxic", "logit_not_toxic")))
    return shares.select(
        "doc_id",
        F.round(F.col("shares")[0], 6).alias("toxic"),
        F.round(F.col("shares")[1], 6).alias("not_toxic"),
    )


def q_toxic_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_columns(documents(spark, folder))
    named = F.create_map(
        F.lit("Toxic"), F.col("score_toxic"), F.lit("Not Toxic"), F.col("score_not_toxic")
    )
    return scored.withColumn("named", named).select(
        "doc_id",
        F.round(S.pick_label(F.col("named"), "toxic"), 4).alias("toxic_score"),
        F.round(S.pick_label(F.col("named"), "threat"), 4).alias("threat_score"),
        F.array_join(F.transform(F.map_keys("named"), T.label_key), ",").alias("labels"),
    )


def q_token_weights(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.token_weights(labelled_texts(spark, folder), min_docs=5)


def q_trained_scores(spark: SparkSession, folder: str) -> DataFrame:
    return bayes_scores(spark, folder).select(
        "doc_id",
        F.round("score_toxic", 4).alias("score"),
        (F.col("score_toxic") >= config.DEFAULT_THRESHOLD).cast("int").alias("predicted"),
    )


def q_holdout_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the fitted scorer on the labelled documents it has not seen."""
    declared = read_table(spark, folder, "documents").select("doc_id", "lang")
    rows = evaluate.attach_truth(declared, labelled(spark, folder), lambda df: df, "doc_id", ["doc_id", "lang"])
    found = rows.where(HELD_OUT).join(bayes_scores(spark, folder), "doc_id")
    predicted = (F.col("score_toxic") >= config.DEFAULT_THRESHOLD).cast("int")
    return evaluate.metrics(found.withColumn("predicted", predicted))


FOLDS = 4
FOLD = f"(instr('0123456789abcdef', substring(md5(cast(doc_id AS string)), 1, 1)) - 1) % {FOLDS}"
"""A fold for every document, by a hash of its key."""


def out_of_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents, each scored by what was learned from the other folds."""
    texts = labelled_texts(spark, folder).withColumn("fold", F.expr(FOLD))
    return scoring.oof_scores(texts, "fold", FOLDS, ["doc_id", "lang", "expected"])


def q_oof_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = out_of_fold(spark, folder)
    return rows.select("doc_id", "lang", "expected", F.col("fold").cast("int"), F.round("score", 4).alias("score"))


def q_oof_calibrate(spark: SparkSession, folder: str) -> DataFrame:
    """The best of all cuts per language, on scores that have not seen the labels they are held against."""
    best = calibrate.calibrate_exact(out_of_fold(spark, folder))
    return best.withColumns({"threshold": F.round("threshold", 6), "f1": F.round("f1", 4)})


def q_oof_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the fitted scorer over all labelled documents, held out in turn."""
    predicted = (F.col("score") >= config.DEFAULT_THRESHOLD).cast("int")
    return evaluate.metrics(out_of_fold(spark, folder).withColumn("predicted", predicted))


def q_byo_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in for a user's own model: every insult halves the distance to 1."""
    scored = scoring.model_scores(documents(spark, folder), _own_model(), ["toxic", "not_toxic"])
    return _rounded_scores(scored)


# --- Verdicts -------------------------------------------------------------------------


def moderate_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _moderated_rows(moderation.moderate(documents(spark, folder)))


def _moderated_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "language",
        "language_raw",
        "verdict",
        "confidence",
        "threshold_used",
        *_flat_categories(),
        _joined("warnings").alias("warnings"),
    )


def _own_model():
    """The loader of a stand-in for a user's own model; local, so that it is sent to workers whole."""

    def load():
        def predict(texts: pd.Series) -> pd.DataFrame:
            toxic = 1 - 0.5 ** texts.str.lower().str.count(BYO_WORDS)
            return pd.DataFrame({"toxic": toxic, "not_toxic": 1 - toxic})

        return predict

    return load


def q_byo_moderate(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the scores of a user's own model: threshold, flags and confidence follow them."""

    def scorer(df: DataFrame) -> DataFrame:
        return scoring.model_scores(df, _own_model(), ["toxic", "not_toxic"])

    rows = moderation.moderate(documents(spark, folder), scorer=scorer)
    flagged = F.col("categories")["toxic"]["flagged"].alias("toxic_flagged")
    return rows.select("doc_id", "verdict", "confidence", "threshold_used", flagged, "error")


def q_error_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of users come without their text: they get an error and no verdict."""
    turns = read_texts(spark, folder, "conversations")
    given = turns.withColumn("text", F.when(F.col("role") != "user", F.col("text")))
    return moderation.batch_summary(moderation.moderate(given), "role")


def q_category_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = moderation.moderate(documents(spark, folder))
    return rows.select("doc_id", *_flat_categories())


def q_verdict_any_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = moderation.moderate(documents(spark, folder), threshold=0.95, rule="any_label")
    return rows.select("doc_id", "verdict", *_flat_categories())


def q_max_label_rule(spark: SparkSession, folder: str) -> DataFrame:
    rows = moderation.moderate(documents(spark, folder), threshold=0.5, rule="max_label")
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def q_top_category(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_columns(documents(spark, folder))
    scores = {label: F.col(f"score_{label}") for label in ("toxic", "not_toxic")}
    return scored.select(
        "doc_id",
        S.top_label(scores).alias("top_category"),
        F.round(S.max_score(scores), 4).alias("top_score"),
    )


def q_flagged_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = moderation.moderate(documents(spark, folder), thresholds={"not_toxic": 0.95})
    return rows.select("doc_id", S.flagged_names(F.col("categories")).alias("flagged"))


def q_safe_verdict(spark: SparkSession, folder: str) -> DataFrame:
    rows = moderation.moderate_safe(messages(spark, folder))
    flagged = F.try_element_at("categories", F.lit("not_toxic"))["flagged"]
    return rows.select(
        "doc_id",
        "pos",
        "verdict",
        "certainty",
        "max_score",
        "note",
        "threshold_used",
        F.size("categories").cast("bigint").alias("n_categories"),
        flagged.alias("not_toxic_flagged"),
    )


def q_dim_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The categories with the number of documents flagged under each."""
    rows = moderation.moderate(documents(spark, folder)).select(F.explode("categories").alias("category", "found"))
    counts = rows.where("found.flagged").groupBy("category").agg(F.count("*").alias("n"))
    return (
        moderation.category_table(spark)
        .join(counts, "category", "left")
        .select("category", F.coalesce("n", F.lit(0)).alias("n_docs"))
    )


def q_display_rows(spark: SparkSession, folder: str) -> DataFrame:
    return moderation.display_rows(moderation.moderate(read_texts(spark, folder, "benchmark")))


def q_stream_moderate(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream, moderated into a history table until the input is used up."""
    path = f"{folder.rstrip('/')}/documents.parquet"
    stream = online.stream_table(spark, path, spark.read.parquet(path).schema)
    texts = spread(stream.select("doc_id", "text"))
    base = scratch_dir(spark)
    rows = _moderated_rows(online.moderate_stream(texts))
    query = online.append_history(rows, f"{base}/history", f"{base}/state", available_now=True)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/history")


# --- Aggregates -----------------------------------------------------------------------


def q_batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per conversation, a conversation being a batch of turns."""
    turns = moderation.moderate(read_texts(spark, folder, "conversations"))
    return moderation.batch_summary(turns, "conv_id")


def q_verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.value_counts(moderation.moderate(documents(spark, folder)), "verdict")


def q_language_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.value_counts(moderation.moderate(messages(spark, folder)), "language")


def q_class_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    declared = read_table(spark, folder, "documents").select("doc_id", "lang")
    truth = labelled(spark, folder)
    rows = evaluate.attach_truth(declared, truth, lambda df: df, "doc_id", ["lang"])
    return evaluate.class_crosstab(rows)


def q_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(evaluated(spark, folder))


def q_accuracy_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(evaluated(spark, folder), "lang")


def q_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(evaluated(spark, folder), "lang")


def q_metrics_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.metrics(evaluated(spark, folder))


def q_error_rates(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.error_rates(evaluated(spark, folder), "lang")


def q_src_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations as CSV files with two orders of columns, read back as texts."""
    turns = read_table(spark, folder, "conversations")
    path = scratch_dir(spark)
    sinks.write_csv(turns.where("role = 'user'").select("conv_id", "turn", "text", "role"), path)
    others = turns.where("role IS NULL OR role <> 'user'")
    sinks.write_csv(others.select("text", "role", "turn", "conv_id"), path, "append")
    back = read_csv_texts(spark, path, multi_line=True)
    return back.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")


def q_src_csv_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as CSV files that disagree: whole and fractional values, days and times, flags and words."""
    events = read_table(spark, folder, "events").select("event_id", "user_id", "value", "ts", "event_type")
    first, path = F.col("event_id") % 2 == 0, scratch_dir(spark)
    days = F.date_format("ts", "yyyy-MM-dd")
    times = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    flag = (F.col("user_id") % 2 == 0).cast("string")
    one = events.where(first).select(
        "event_id", F.floor("value").alias("value"), days.alias("seen"), days.alias("day"), flag.alias("even"),
        F.lit("1").alias("mixed"),
    )
    two = events.where(~first).select(
        F.col("event_type").alias("mixed"), flag.alias("even"), times.alias("seen"), days.alias("day"), "value", "event_id"
    )
    sinks.write_csv(one, path)
    sinks.write_csv(two, path, "append")
    found = typed_columns(read_csv(spark, path).drop("_corrupt_record"))
    kinds = F.concat_ws(",", *[F.typeof(name) for name in ("event_id", "value", "seen", "day", "even", "mixed")])
    return found.select(
        "event_id", F.round("value", 4).alias("value"), F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("seen"),
        F.date_format("day", "yyyy-MM-dd").alias("day"), "even", "mixed", kinds.alias("kinds"),
    )


def q_recorded_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A moderation run for every source of the documents, as the runs table tells them afterwards."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    base = scratch_dir(spark)
    for lang in [row["lang"] for row in docs.select("lang").distinct().orderBy("lang").collect()]:
        rows = moderation.moderate(docs.where(F.col("lang").eqNullSafe(lang)))
        runs.recorded(rows, lambda df: df.write.mode("append").parquet(f"{base}/out"), f"{base}/runs", str(lang))
    found = runs.read_runs(spark, f"{base}/runs")
    speed = evaluate.throughput(found).select("batch_size", (F.col("per_text_ms") > 0).alias("timed"))
    return found.join(speed, "batch_size").select("name", "batch_size", *runs.COUNTERS, "timed")


def q_meaning_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Texts side by side by language, as a table of translations has them: the first toxic and the first clean
    ones of each length class, turned to rows, scored, and compared with English."""
    rows = _predict(labelled_pairs(spark, folder))
    return evaluate.score_gap(rows, "meaning", ["en", "de", "es", "fr"])


def labelled_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``meaning, lang, text``: one column per language, unpivoted."""
    docs = read_table(spark, folder, "documents").join(labelled(spark, folder), "doc_id")
    meaning = F.concat_ws("-", F.col("expected"), F.floor(F.log2(F.col("n_chars") + 1)).cast("int"))
    langs = ["en", "de", "es", "fr"]
    side_by_side = docs.groupBy(meaning.alias("meaning")).agg(
        *[F.min_by("text", F.when(F.col("lang") == lang, F.col("doc_id"))).alias(lang) for lang in langs]
    )
    return evaluate.parallel_texts(side_by_side, "meaning", langs).where("text IS NOT NULL")


def q_sink_results(spark: SparkSession, folder: str) -> DataFrame:
    """The result table of the benchmark passages, written as CSV and read back."""
    path = scratch_dir(spark)
    sinks.write_results_csv(moderation.moderate(read_texts(spark, folder, "benchmark")), path)
    return read_csv(spark, path, multi_line=True).select(
        "text", "language", "verdict", F.col("toxic_score").cast("double"), "threshold"
    )


def q_sink_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict rows of the conversations as CSV, nested columns as JSON, read back and unfolded."""
    path = scratch_dir(spark)
    turns = read_texts(spark, folder, "conversations").select("conv_id", "turn", "text")
    sinks.write_csv(moderation.moderate(turns).drop("text"), path)
    back = read_csv(spark, path)
    categories = F.from_json("categories", moderation.CATEGORIES_TYPE)
    return back.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        "verdict",
        F.col("confidence").cast("double"),
        categories["toxic"]["score"].alias("toxic_score"),
        categories["toxic"]["flagged"].alias("toxic_flagged"),
    )


def q_sink_by_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The moderated documents in one folder per verdict, read back."""
    path = scratch_dir(spark)
    sinks.write_moderated(moderation.moderate(documents(spark, folder)), path)
    return spark.read.parquet(path).select("doc_id", "language", "verdict", "confidence")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/events.parquet"
    stream = online.stream_table(spark, path, spark.read.parquet(path).schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _to_the_end(spark: SparkSession, rows: DataFrame) -> DataFrame:
    base = scratch_dir(spark)
    query = online.append_history(rows, f"{base}/out", f"{base}/state", available_now=True)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def q_stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream in which every delivery comes twice, each kept once."""
    stream = _event_stream(spark, folder).select("event_id", "ts", "event_type")
    twice = stream.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = online.once_per_request(twice, "event_id", "ts", "60 days")
    found = _to_the_end(spark, kept.select("event_id", "event_type"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


def q_stream_verdict_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day as a stream, those of a value over 100 taken as flagged."""
    verdict = F.when(F.col("value") > 100, "toxic").otherwise("clean").alias("verdict")
    stream = _event_stream(spark, folder).select("ts", verdict)
    rates = _to_the_end(spark, online.verdict_rate(stream, "ts", "1 day", "0 seconds"))
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def _document_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/documents.parquet"
    stream = online.stream_table(spark, path, spark.read.parquet(path).schema)
    return stream.select("doc_id", "text", "lang")


def _by_batches(spark: SparkSession, stream: DataFrame, transform, schema, partition_by=()) -> DataFrame:
    """A stream written batch by batch until the input is used up, and read back."""
    base = scratch_dir(spark)
    query = online.write_batches(stream, f"{base}/out", f"{base}/state", transform, partition_by, available_now=True)
    query.awaitTermination()
    return online.read_batches(spark, f"{base}/out", schema)


def q_stream_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream, scored by the fitted naive Bayes."""
    weights, bias = scoring.naive_bayes(labelled_texts(spark, folder).where(f"NOT {HELD_OUT}"))
    weights = materialise(weights)

    def scored(batch: DataFrame) -> DataFrame:
        rows = scoring.score_by_join(batch, weights, bias, key="doc_id")
        return rows.select("doc_id", F.round("score_toxic", 4).alias("score"))

    schema = scored(documents(spark, folder).limit(0)).schema
    return _by_batches(spark, _document_stream(spark, folder), scored, schema).drop("batch")


def q_stream_language(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream, their language told by learned n-grams."""
    grams = materialise(language.learn_grams(documents(spark, folder).where(f"NOT {HELD_OUT}")))

    def told(batch: DataFrame) -> DataFrame:
        return language.detect_learned(batch, grams, "doc_id").select("doc_id", "detected", "confidence")

    schema = told(documents(spark, folder).limit(0)).schema
    return _by_batches(spark, _document_stream(spark, folder), told, schema).drop("batch")


def q_stream_by_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream, moderated into one folder per batch and verdict."""
    kept = ("doc_id", "language", "verdict", "confidence")
    schema = moderation.moderate(documents(spark, folder)).select(*kept).schema

    def moderated(batch: DataFrame) -> DataFrame:
        return moderation.moderate(spread(batch)).select(*kept)

    return _by_batches(spark, _document_stream(spark, folder), moderated, schema, ["verdict"]).drop("batch")


def q_stream_history(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations as a stream, the newest 20 turns of each kept as state."""
    path = f"{folder.rstrip('/')}/conversations.parquet"
    stream = online.stream_table(spark, path, spark.read.parquet(path).schema)
    history = online.session_history(stream, "conv_id", "turn", "text", keep=20)
    base = scratch_dir(spark)
    writer = history.writeStream.foreachBatch(online.batch_writer(f"{base}/out")).outputMode("update")
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    batches = online.read_batches(spark, f"{base}/out", history.schema)
    return online.latest_history(batches, "conv_id").drop("batch")


def q_score_stats(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score_stats(evaluated(spark, folder))


def q_score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score_histogram(learned_scores(spark, folder))


def q_latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.measure_summary(read_table(spark, folder, "events"), "value", "event_type")


def q_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded runs: one per user, its events being the texts of the batch."""
    runs = (
        read_table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.count("*").alias("batch_size"), F.sum("value").alias("total_ms"))
    )
    return evaluate.throughput(runs)


def q_threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.threshold_sweep(evaluated(spark, folder))


def q_threshold_calibrate(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.calibrate(learned_scores(spark, folder), FINE_GRID)


def q_score_gap(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score_gap(evaluated(spark, folder), "expected", ["en", "de", "es", "fr"])


# --- Errors, comparison, reports ------------------------------------------------------


def q_false_positives(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.false_positives(by_max_label(spark, folder))
    return rows.select("doc_id", "lang", F.round("score", 4).alias("score"))


def q_false_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.false_negatives(evaluated(spark, folder))
    return rows.select("doc_id", "lang", F.round("score", 4).alias("score"))


def q_misclassified(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluated(spark, folder, "preview")
    wrong = evaluate.misclassified(rows.withColumnRenamed("preview", "text"))
    return wrong.select(
        "doc_id", "lang", "expected_label", "predicted_label", F.col("text").alias("preview")
    )


def q_edge_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.edge_summary(moderation.moderate(messages(spark, folder)))


def q_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    both = evaluated(spark, folder, "predicted_max")
    return compare.ensemble(both, "predicted_max", "predicted")


def q_ensemble_undecided(spark: SparkSession, folder: str) -> DataFrame:
    """The same where the first scorer has failed on French and the second on long documents."""
    both = evaluated(spark, folder, "predicted_max", "text")
    failing = both.withColumns(
        {
            "predicted_max": F.when(F.col("lang") != "fr", F.col("predicted_max")),
            "predicted": F.when(F.char_length("text") <= 2000, F.col("predicted")),
        }
    )
    return compare.ensemble(failing, "predicted_max", "predicted")


def q_model_compare_undecided(spark: SparkSession, folder: str) -> DataFrame:
    both = evaluated(spark, folder, "predicted_max", "score_max")
    failing = both.withColumn("predicted", F.when(F.col("expected") + F.col("predicted") < 2, F.col("predicted")))
    models = {"max_label": ("predicted_max", "score_max"), "toxic_label": ("predicted", "score")}
    return compare.compare_models(failing, models).where("metric IN ('accuracy', 'false_positives')")


def q_paired_results(spark: SparkSession, folder: str) -> DataFrame:
    """Two result tables made apart, paired by document, and how often they agree."""
    paired = compare.pair_results(by_max_label(spark, folder), evaluated(spark, folder), "doc_id")
    return paired.groupBy("expected", "predicted_a", "predicted_b").agg(F.count("*").alias("n"))


def q_model_compare(spark: SparkSession, folder: str) -> DataFrame:
    both = evaluated(spark, folder, "predicted_max", "score_max")
    return compare.compare_models(
        both,
        {"max_label": ("predicted_max", "score_max"), "toxic_label": ("predicted", "score")},
        by="lang",
    )


def q_append_rows(spark: SparkSession, folder: str) -> DataFrame:
    base = read_table(spark, folder, "documents").select("text", "lang")
    extra = read_table(spark, folder, "benchmark").select("text")
    rows = compare.append_rows(base, extra)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def q_report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """With a latency column: as the tables record none, a millisecond per hundred characters."""
    names = language.language_table(spark)
    rows = evaluated(spark, folder, "latency_ms")
    return report.report_lines(evaluate.metrics(rows, latency="latency_ms"), names=names)


def q_report_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The nested report, unfolded again into one row per language plus the overall row."""
    nested = report.report_document(
        evaluate.metrics(evaluated(spark, folder)), "keywords", config.DEFAULT_THRESHOLD
    )
    everything = F.map_concat("per_language", F.create_map(F.lit("overall"), F.col("overall")))
    rows = nested.select("model", "threshold", F.explode(everything).alias("lang", "m"))
    return rows.select("model", "threshold", "lang", "m.*")


def q_head_preview(spark: SparkSession, folder: str) -> DataFrame:
    return report.head_preview(read_table(spark, folder, "documents"), "doc_id")


def q_recent_history(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 newest turns, newest first, moderated for display."""
    turns = report.recent(read_table(spark, folder, "conversations"), ["conv_id", "turn"])
    rows = moderation.moderate(turns).withColumn("text", T.preview(F.col("text"), 60))
    return rows.select("conv_id", "turn", "text", "language", "verdict", "threshold_used")


def registry() -> dict:
    """All queries by name."""
    own = {name[2:]: run for name, run in globals().items() if name.startswith("q_")}
    return {"moderate": moderate_documents, **own}
