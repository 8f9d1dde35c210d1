"""The moderation transform: text in, one verdict row out, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textwarden import config
from textwarden.functions import language as L
from textwarden.functions import score as S
from textwarden.functions import text as T
from textwarden.operators.language import Profile
from textwarden.util import settle

RULES = ("toxic_label", "max_label", "any_label")

RESULT_COLUMNS = (
    "language", "language_raw", "verdict", "categories", "confidence", "threshold_used", "warnings", "error",
)

MISSING_TEXT = "missing_text"
NO_MODEL = config.LinearModel({}, {})

CATEGORIES_TYPE = "map<string,struct<score:double,flagged:boolean>>"


def _option(value: float | str | Column | None) -> Column | None:
    """A per-row option: a number for all rows, a column name, or a column."""
    if value is None or isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def _limits(value: Mapping[str, float] | str | Column | None) -> Column | None:
    if isinstance(value, Mapping):
        return L.literal_map({label: float(limit) for label, limit in value.items()})
    return F.col(value) if isinstance(value, str) else value


def read_text(
    df: DataFrame,
    text: str,
    model: config.LinearModel,
    profile: Profile,
    max_tokens: int | None,
    min_words: int,
) -> DataFrame:
    """Add all that needs the text itself: ``_blank, _best, _x_<label>, warnings``.

    The tokens are walked through once; what remains are marker words and scored words.
    """
    out = df.withColumn("_stripped", T.strip(F.col(text)))
    out = out.withColumn("_cleaned", T.collapse_repeats(F.col("_stripped")))
    words = T.pieces if max_tokens is None else T.tokens
    out = out.withColumn("_tokens", words(F.col("_cleaned")))
    wanted = tuple(sorted({*L.markers(profile), *model.vocabulary}))
    known, scored = {"_known": L.known_tokens("_tokens", wanted)}, "_known"
    if max_tokens is not None:
        scored = "_scored"
        known[scored] = L.keep(f"slice(_tokens, 1, {int(max_tokens)})", model.vocabulary)
    out = out.withColumns(known)
    out = out.withColumn("_script", L.script_votes(F.col("_cleaned"), "_known"))
    logits = S.label_logits(scored, model)
    found = {
        "_blank": F.col("_stripped") == "",
        "_best": L.leader(L.ballot("_known", "_script", profile)),
        "warnings": T.warnings(F.col("_stripped"), min_words),
        **{f"_x_{label}": logit for label, logit in logits.items()},
    }
    return settle(out.withColumns(found), *found)


def moderate(
    df: DataFrame,
    text: str = "text",
    *,
    settings: config.Settings = config.DEFAULT_SETTINGS,
    model: config.LinearModel = config.DEFAULT_MODEL,
    profile: Profile = config.DEFAULT_PROFILE,
    language: str | None = None,
    threshold: float | str | Column | None = None,
    thresholds: Mapping[str, float] | str | Column | None = None,
    rule: str = "toxic_label",
    max_tokens: int | None = None,
    keep_scores: bool = False,
    scores: Mapping[str, str] | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Moderate every row; all input columns stay and the result columns are added.

    Order of work: strip, blank and short checks, repeat collapse, language, threshold, scores,
    flags, verdict. A threshold given for a label (``thresholds``) beats ``threshold``, which
    beats the language's own; 0.0 counts as given. Flags compare unrounded scores.

    ``rule`` decides the verdict: ``toxic_label`` reads the toxic flag, ``max_label`` compares the
    best score of all labels, ``any_label`` holds every label to the same threshold.
    ``keep_scores`` also keeps the unrounded ``score_<label>`` columns (null for blank texts).

    Scores of one's own take the place of ``model``: ``scores`` names ready columns by label
    (``{"toxic": "score_toxic", ...}``), or ``scorer`` adds ``score_<label>`` columns for
    ``model``'s labels, e.g. ``lambda df: model_scores(df, load, ["toxic", "not_toxic"])``. A column
    ``error`` that comes with them tells the rows the model failed on.

    Rows without a text (``error`` is ``missing_text``), with an error, or without any score though
    they have a text (``missing_score``) get no verdict, confidence, categories or threshold.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    labels = tuple(scores) if scores is not None else model.labels
    kept = list(df.columns)
    if scorer is not None:
        df = scorer(df)
        scores = {label: f"score_{label}" for label in labels}
        kept = [name for name in kept if name in df.columns]
    own_scores = scores is not None
    failure = F.lit(None).cast("string")
    if own_scores and "error" in df.columns:
        failure = F.col("_failure")
        df = df.withColumnRenamed("error", "_failure")
    kept = [name for name in kept if name != "error"]
    if own_scores:
        df = df.withColumns({f"_own_{label}": F.col(name) for label, name in scores.items()})
    out = read_text(df, text, NO_MODEL if own_scores else model, profile, max_tokens, settings.min_words)
    blank = F.coalesce(F.col("_blank"), F.lit(True))

    detected = F.when(blank, config.UNKNOWN_LANGUAGE).otherwise(L.winner(F.col("_best")))
    out = out.withColumn("language_raw", detected)
    mapped = L.supported_language(F.col("language_raw"), settings)
    chosen = mapped if language is None else F.coalesce(F.col(language), mapped)
    out = out.withColumn("language", F.when(blank, config.UNKNOWN_LANGUAGE).otherwise(chosen))

    own = S.threshold_for(F.col("language"), settings)
    given = _option(threshold)
    limit = own if given is None else F.coalesce(given, own)
    found = {
        label: F.col(f"_own_{label}") if own_scores else S.sigmoid(F.col(f"_x_{label}")) for label in labels
    }
    unscored = ~blank & F.coalesce(*found.values()).isNull() if own_scores else F.lit(False)
    out = out.withColumn(
        "_error",
        F.when(F.col(text).isNull(), MISSING_TEXT)
        .when(failure.isNotNull(), failure)
        .when(unscored, "missing_score"),
    )
    out = out.withColumns(
        {
            "threshold_used": F.when(~blank & F.col("_error").isNull(), limit),
            **{f"score_{label}": F.when(~blank, score) for label, score in found.items()},
        }
    )

    undecided = F.col("_error").isNotNull()
    score = {label: F.col(f"score_{label}") for label in labels}
    used = F.col("threshold_used")
    flagged = S.flags(
        score,
        used,
        _limits(thresholds),
        other=None if rule == "any_label" else settings.other_label_threshold,
    )
    decision = {
        "toxic_label": lambda: flagged[S.TOXIC],
        "max_label": lambda: S.max_score(score) >= used,
        "any_label": lambda: S.any_flag(flagged),
    }[rule]()
    out = out.withColumns(
        {
            "verdict": F.when(~undecided, S.binary_verdict(~blank & decision)),
            "categories": F.when(
                ~undecided,
                F.when(blank, F.expr(f"cast(map() as {CATEGORIES_TYPE})")).otherwise(
                    S.categories(score, flagged)
                ),
            ),
            "confidence": F.when(
                ~undecided, F.when(blank, 0.0).otherwise(F.round(S.max_score(score), 4))
            ),
            "warnings": F.when(F.col(text).isNotNull(), F.col("warnings")).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )
    extra = [f"score_{label}" for label in labels] if keep_scores else []
    kept = [name for name in kept if name not in extra]
    return out.withColumn("error", F.col("_error")).select(*kept, *RESULT_COLUMNS, *extra)


def moderate_safe(
    df: DataFrame,
    text: str = "text",
    *,
    model: config.LinearModel = config.DEFAULT_MODEL,
    min_words: int = config.MIN_WORDS,
    keep_marks: bool = False,
    label: str | None = S.TOXIC,
    max_tokens: int | None = None,
    threshold: float = config.DEFAULT_THRESHOLD,
) -> DataFrame:
    """Moderation with guards: short texts are clean, the rest is normalised and routed three ways.

    Adds ``verdict`` (toxic, needs_review, clean), ``certainty`` (high, uncertain; null for short
    texts), ``max_score``, ``note``, ``categories`` (flags at ``threshold``; none for short texts) and
    ``threshold_used``. ``label=None`` routes by the best score of all labels. Texts that are null
    get no verdict, score or categories, and ``missing_text`` as their note.
    """
    out = df.withColumn("_long", T.has_words(T.strip(F.col(text)), min_words))
    plain = T.normalise_strict(F.col(text), keep_marks)
    words = T.pieces(plain) if max_tokens is None else T.tokens(plain, max_tokens)
    out = out.withColumn("_words", words).withColumn("_hits", L.keep("_words", model.vocabulary))
    scores = S.label_scores("_hits", model)
    best = S.max_score(scores) if label is None else scores[label]
    limit = F.lit(float(threshold))
    found = S.categories(scores, {name: score >= limit for name, score in scores.items()})
    out = out.withColumns(
        {
            "max_score": F.when(F.col("_long"), F.round(best, 4)).when(F.col(text).isNotNull(), 0.0),
            "categories": F.when(F.col("_long"), found).when(
                F.col(text).isNotNull(), F.expr(f"cast(map() as {CATEGORIES_TYPE})")
            ),
        }
    )
    out = settle(out.drop("_words", "_hits"), "_long", "max_score", "categories")
    verdict, certainty = S.route(F.col("max_score"))
    return out.withColumns(
        {
            "verdict": F.when(F.col("_long"), verdict).when(F.col(text).isNotNull(), "clean"),
            "certainty": F.when(F.col("_long"), certainty),
            "note": F.when(F.col(text).isNull(), MISSING_TEXT).when(~F.col("_long"), F.lit(config.SHORT_NOTE)),
            "threshold_used": F.when(F.col("_long"), limit),
        }
    ).select(*df.columns, "verdict", "certainty", "max_score", "note", "categories", "threshold_used")


def moderate_batches(
    df: DataFrame, texts: str = "texts", position: str = "position", **options: object
) -> DataFrame:
    """Moderate array-shaped requests: one row per text, ``position`` keeps the order given.

    All options of :func:`moderate` apply; a column named by an option is read per request.
    """
    others = [name for name in df.columns if name != texts]
    rows = df.select(*others, F.posexplode(texts).alias(position, "text"))
    return moderate(rows, "text", **options)


def batch_summary(df: DataFrame, by: str | list[str] | None = None) -> DataFrame:
    """``total_texts, flagged_count, clean_count, undecided_count`` over everything or per group."""
    groups = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*groups).agg(
        F.count("*").alias("total_texts"),
        F.count_if(F.col("verdict") == "toxic").alias("flagged_count"),
        F.count_if(F.col("verdict") != "toxic").alias("clean_count"),
        F.count_if(F.col("verdict").isNull()).alias("undecided_count"),
    )


def run_counters() -> list[Column]:
    """The counters of a run, as aggregates over moderated rows."""
    toxic = F.col("verdict") == "toxic"
    return [
        F.count(F.lit(1)).alias("total_texts"),
        F.count_if(toxic).alias("flagged_count"),
        F.count_if(~toxic).alias("clean_count"),
        F.count_if(F.col("threshold_used").isNull() & F.col("verdict").isNotNull()).alias("skipped_count"),
        F.count_if(F.col("verdict").isNull()).alias("undecided_count"),
    ]


def observe_run(moderated: DataFrame, name: str = "moderation") -> tuple[DataFrame, Observation]:
    """Count a run while it is written: no second pass over the texts is needed for its summary.

    Use the returned DataFrame for the write; afterwards ``observation.get`` holds
    ``total_texts, flagged_count, clean_count``, ``skipped_count`` (blank texts) and
    ``undecided_count`` (without a verdict).
    """
    observation = Observation(name)
    observed = moderated.observe(observation, *run_counters())
    return observed, observation


def display_rows(df: DataFrame, n: int = 80, text: str = "text") -> DataFrame:
    """The result table people read: shortened text, language, verdict, score, threshold."""
    toxic = F.try_element_at("categories", F.lit(S.TOXIC))["score"]
    return df.select(
        T.preview(F.col(text), n).alias("text"),
        "language",
        "verdict",
        F.round(F.coalesce(toxic, F.lit(0.0)), 4).alias("toxic_score"),
        F.coalesce(F.col("threshold_used").cast("string"), F.lit("N/A")).alias("threshold"),
    )


def category_table(spark, model: config.LinearModel = config.DEFAULT_MODEL) -> DataFrame:
    """The categories a model tells: ``category``."""
    return spark.createDataFrame([(label,) for label in model.labels], "category string")
