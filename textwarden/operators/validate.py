"""Request rules as row rules: every row gets the list of rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import config

PROFILES = ("single", "batch")


def rule(broken: Column, reason: str) -> Column:
    """The reason where the rule is broken, else null."""
    return F.when(broken, F.lit(reason))


def text_rules(text: Column, profile: str = "single") -> list[Column]:
    """``single`` checks presence and length; in a batch any present text is accepted."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
    rules = [rule(text.isNull(), "missing_text")]
    if profile == "single":
        length = F.char_length(text)
        rules += [
            rule(length < config.MIN_TEXT_CHARS, "text_too_short"),
            rule(length > config.MAX_TEXT_CHARS, "text_too_long"),
        ]
    return rules


def threshold_rule(threshold: Column) -> Column:
    return rule(threshold.isNotNull() & ~threshold.between(0.0, 1.0), "threshold_out_of_range")


def batch_rules(texts: Column) -> list[Column]:
    return [
        rule(texts.isNull(), "missing_texts"),
        rule(F.size(texts) < config.MIN_BATCH_TEXTS, "batch_empty"),
        rule(F.size(texts) > config.MAX_BATCH_TEXTS, "batch_too_large"),
        rule(F.exists(texts, lambda t: t.isNull()), "missing_text"),
    ]


def validate(
    df: DataFrame, text: str = "text", threshold: str | None = None, profile: str = "single"
) -> DataFrame:
    """Add ``errors``: the reasons for rejecting a row in rule order, empty if it is valid."""
    rules = text_rules(F.col(text), profile)
    if threshold is not None:
        rules.append(threshold_rule(F.col(threshold)))
    return df.withColumn("errors", F.array_compact(F.array(*rules)))


def validate_batch(df: DataFrame, texts: str = "texts", threshold: str | None = None) -> DataFrame:
    """The same for rows that hold a whole batch as an array of texts."""
    # size(null) is -1 or null depending on a session setting, so absence masks the size rules.
    missing, *others = batch_rules(F.col(texts))
    rules = [missing, *[F.when(F.col(texts).isNotNull(), other) for other in others]]
    if threshold is not None:
        rules.append(threshold_rule(F.col(threshold)))
    return df.withColumn("errors", F.array_compact(F.array(*rules)))


def split_valid(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Accepted rows (without the error column) and rejected rows."""
    valid = F.size(errors) == 0
    return df.where(valid).drop(errors), df.where(~valid)


def with_status(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Add ``status``: ``accepted`` or ``rejected``. Written partitioned by it, both sides come from one pass."""
    return df.withColumn("status", F.when(F.size(errors) == 0, "accepted").otherwise("rejected"))


def reject_summary(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Rejected rows per reason; a row breaking two rules counts under both."""
    return df.select(F.explode(errors).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
