"""Evaluation of verdicts against truth.

Input rows carry ``expected`` and ``predicted`` (0/1), ``score`` and a language column. All
statistics are sums, so they are formed map-side; per-group and overall figures come from one
pass, the overall row being added up from the finished groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden import config
from textwarden.functions import text as T

COUNTS = ("tp", "fp", "fn", "tn")
OTHER_SCRIPTS = r"[\u0600-\u06ff\u0750-\u077f\u0900-\u097f]"


def attach_truth(
    texts: DataFrame,
    truth: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    key: str,
    keep: Sequence[str],
    score_first: bool = False,
) -> DataFrame:
    """Score the texts that have a truth row; returns ``keep`` plus the truth columns.

    Texts meet the truth first, so only labelled ones are scored; Spark picks the join by the
    bytes of the two sides. ``score_first`` scores all texts where they lie and moves only the
    ``keep`` columns, which is less work where most texts are labelled. Several truth rows of
    one key count as one, with the largest value of every column.
    """
    extra = [name for name in truth.columns if name != key]
    once = truth.groupBy(key).agg(*[F.max(name).alias(name) for name in extra])
    if score_first:
        return score(texts).select(*keep).join(once, key)
    return score(texts.join(once, key)).select(*keep, *extra)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def confusion(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """``tp, fp, fn, tn, total, undecided`` in one pass, over everything or per group.

    Rows without a prediction (an own model failed on them) are undecided and not in ``total``.
    """
    groups = [by] if isinstance(by, str) else list(by or [])
    hit, truth = F.col("predicted") == 1, F.col("expected") == 1
    return df.groupBy(*groups).agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
        F.count("predicted").alias("total"),
        F.count_if(F.col("predicted").isNull()).alias("undecided"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1 (four digits) to confusion counts."""
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns(
        {
            "accuracy": F.round(ratio(F.col("tp") + F.col("tn"), F.col("total")), 4),
            "precision": F.round(precision, 4),
            "recall": F.round(recall, 4),
            "f1": F.round(ratio(2 * precision * recall, precision + recall), 4),
        }
    )


def metrics(
    df: DataFrame, by: str = "lang", overall: str = "overall", latency: str | None = None
) -> DataFrame:
    """Counts and metrics per group, plus one row ``overall`` for all rows together.

    Rows without a group count under the name ``unknown``. With ``latency`` the mean of that
    column is reported as ``avg_latency_ms`` (two digits).
    """
    group = F.coalesce(F.col(by), F.lit(config.UNKNOWN_LANGUAGE)).alias(by)
    sums = [F.sum(name).alias(name) for name in (*COUNTS, "total", "undecided")]
    hit, truth = F.col("predicted") == 1, F.col("expected") == 1
    aggregates = [
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
        F.count("predicted").alias("total"),
        F.count_if(F.col("predicted").isNull()).alias("undecided"),
    ]
    if latency is not None:
        aggregates += [F.sum(latency).alias("_ms"), F.count(latency).alias("_timed")]
        sums += [F.sum(name).alias(name) for name in ("_ms", "_timed")]
    groups = df.groupBy(group).agg(*aggregates)
    rolled = groups.rollup(by).agg(*sums)
    out = with_metrics(rolled.withColumn(by, F.coalesce(by, F.lit(overall))))
    if latency is not None:
        out = out.withColumn(
            "avg_latency_ms", F.round(F.try_divide(F.col("_ms"), F.col("_timed")), 2)
        ).drop("_ms", "_timed")
    return out


def accuracy(df: DataFrame, by: str | None = None) -> DataFrame:
    """``correct, total, accuracy``."""
    right = F.count_if(F.col("predicted") == F.col("expected"))
    decided = F.count("predicted").alias("total")
    counts = df.groupBy(*([by] if by else [])).agg(right.alias("correct"), decided)
    return counts.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("total")), 4))


def error_rates(df: DataFrame, by: str | None = None) -> DataFrame:
    """False positives among the clean and false negatives among the toxic texts."""
    counts = confusion(df, by)
    negatives, positives = F.col("fp") + F.col("tn"), F.col("fn") + F.col("tp")
    return counts.select(
        *([by] if by else []),
        "fp",
        negatives.alias("negatives"),
        F.round(ratio(F.col("fp"), negatives), 4).alias("fpr"),
        "fn",
        positives.alias("positives"),
        F.round(ratio(F.col("fn"), positives), 4).alias("fnr"),
    )


def class_crosstab(df: DataFrame, by: str = "lang") -> DataFrame:
    """Number of clean and toxic texts per group, zero where there is none."""
    return df.groupBy(by).agg(
        F.count_if(F.col("expected") == 0).alias("clean"),
        F.count_if(F.col("expected") == 1).alias("toxic"),
    )


def score_stats(df: DataFrame, by: Sequence[str] = ("expected",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 4).alias("avg_score"),
        F.round(F.min("score"), 4).alias("min_score"),
        F.round(F.max("score"), 4).alias("max_score"),
    )


def score_histogram(
    df: DataFrame, by: Sequence[str] = ("lang", "expected"), bins: int = config.HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins over each group's own range; the last bin includes the maximum.

    Scores enter rounded to four digits, so counting equal ones first leaves at most 10,001
    rows per group, however large the group was. Only those are windowed and binned. A group
    without a range has all its rows in the middle bin.
    """
    by = list(by)
    counted = df.groupBy(*by, F.round("score", 4).alias("_s")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    lo, hi = F.col("_lo"), F.col("_hi")
    place = F.floor(F.try_divide(F.col("_s") - lo, hi - lo) * bins).cast("int")
    return (
        counted.withColumns({"_lo": F.min("_s").over(group), "_hi": F.max("_s").over(group)})
        .withColumn("bin", F.when(lo == hi, bins // 2).otherwise(F.least(place, F.lit(bins - 1))))
        .groupBy(*by, "bin")
        .agg(
            F.sum("_n").alias("n"),
            F.min("_lo").alias("range_min"),
            F.max("_hi").alias("range_max"),
        )
    )


def measure_summary(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Mean, smallest and largest value of a measured column, e.g. a latency."""
    return df.groupBy(*([by] if by else [])).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 2).alias("avg_ms"),
        F.round(F.min(value), 2).alias("min_ms"),
        F.round(F.max(value), 2).alias("max_ms"),
    )


def throughput(runs: DataFrame, size: str = "batch_size", total: str = "total_ms") -> DataFrame:
    """Time per text and texts per second for each batch size of recorded runs."""
    return (
        runs.groupBy(size)
        .agg(F.count("*").alias("runs"), F.sum(total).alias("_ms"), F.sum(size).alias("_texts"))
        .select(
            size,
            "runs",
            F.round(F.try_divide(F.col("_ms"), F.col("_texts")), 2).alias("per_text_ms"),
            F.round(F.try_divide(F.col("_texts") * 1000, F.col("_ms")), 2).alias("texts_per_sec"),
        )
    )


def threshold_sweep(
    df: DataFrame, grid: Sequence[float] = config.SWEEP_GRID, by: str | None = None
) -> DataFrame:
    """Confusion counts and metrics at every threshold of the grid.

    A row is not repeated per threshold. It is counted once under the number of thresholds it
    reaches; these few counts are then spread over the grid and added up.
    """
    limits = sorted(float(t) for t in grid)
    groups = [by] if by else []
    reached = F.size(F.filter(F.array(*map(F.lit, limits)), lambda t: F.col("score") >= t))
    truth = F.col("expected") == 1
    counted = df.groupBy(*groups, reached.alias("_reached")).agg(
        F.count_if(truth).alias("_pos"), F.count_if(~truth).alias("_neg")
    )
    points = F.array(
        *[F.struct(F.lit(i + 1).alias("rank"), F.lit(t).alias("threshold")) for i, t in enumerate(limits)]
    )
    hit = F.col("_reached") >= F.col("_p.rank")

    def add(name: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(name)).otherwise(0))

    counts = (
        counted.withColumn("_p", F.explode(points))
        .groupBy(*groups, F.col("_p.threshold").alias("threshold"))
        .agg(
            add("_pos", hit).alias("tp"),
            add("_neg", hit).alias("fp"),
            add("_pos", ~hit).alias("fn"),
            add("_neg", ~hit).alias("tn"),
            F.sum(F.col("_pos") + F.col("_neg")).alias("total"),
        )
    )
    return with_metrics(counts)


def calibrate(df: DataFrame, grid: Sequence[float] = config.SWEEP_GRID, by: str = "lang") -> DataFrame:
    """Best threshold per group by F1; a tie goes to the higher threshold.

    ``separable`` is false where no threshold does better than chance on that group, i.e. none
    catches a larger share of toxic than of clean texts.
    """
    sweep = threshold_sweep(df, grid, by)
    f1 = ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    gain = ratio(F.col("tp"), F.col("tp") + F.col("fn")) - ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    group = Window.partitionBy(by)  # one row per grid point
    best = group.orderBy(F.desc("_f1"), F.desc("threshold"))
    return (
        sweep.withColumns({"_f1": f1, "_gain": gain})
        .withColumns(
            {"_rank": F.row_number().over(best), "separable": F.max("_gain").over(group) > 0}
        )
        .where(F.col("_rank") == 1)
        .select(by, "threshold", "tp", "fp", "fn", "tn", "f1", "separable")
    )


def calibrated_thresholds(df: DataFrame, calibrated: DataFrame, by: str = "lang") -> DataFrame:
    """Add ``threshold``, the calibrated one of the row's group; null where a group has none or is
    not separable. The column can be given to ``moderate`` as its ``threshold``."""
    return df.join(calibrated.where("separable").select(by, "threshold"), by, "left")


def score_gap(df: DataFrame, by: str, langs: Sequence[str], base: str = "en") -> DataFrame:
    """Mean score per language, side by side, and its distance from the base language.

    ``by`` tells the groups of texts with one meaning; one row comes out per group.
    """
    means = df.groupBy(by).agg(
        *[F.round(F.avg(F.when(F.col("lang") == lang, F.col("score"))), 4).alias(lang) for lang in langs]
    )
    gaps = [F.round(F.col(lang) - F.col(base), 4).alias(f"gap_{lang}") for lang in langs if lang != base]
    return means.select(by, *langs, *gaps)


def parallel_texts(df: DataFrame, key: str | Sequence[str], langs: Sequence[str]) -> DataFrame:
    """Turn one column per language into rows ``key, lang, text``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.unpivot(keys, list(langs), "lang", "text")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; equal counts in order of the value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def false_positives(df: DataFrame) -> DataFrame:
    return df.where((F.col("expected") == 0) & (F.col("predicted") == 1))


def false_negatives(df: DataFrame) -> DataFrame:
    return df.where((F.col("expected") == 1) & (F.col("predicted") == 0))


def misclassified(df: DataFrame, text: str = "text", n: int = 55) -> DataFrame:
    """Wrong rows with both verdicts spelled out and a shortened text."""

    def word(flag: str) -> Column:
        return F.when(F.col(flag) == 1, "TOXIC").otherwise("CLEAN")

    return df.where(F.col("expected") != F.col("predicted")).withColumns(
        {
            "expected_label": word("expected"),
            "predicted_label": word("predicted"),
            "preview": T.preview(F.col(text), n),
        }
    )


def edge_kind(text: Column) -> Column:
    """What makes a text hard: blank, short, symbols, repeats, caps, mixed_script, or plain."""
    stripped = T.strip(text)
    return (
        F.when(stripped == "", "blank")
        .when(~stripped.rlike(r"[\p{L}\p{N}]"), "symbols")
        .when(~T.has_words(stripped, config.MIN_WORDS), "short")
        .when(stripped.rlike(T.REPEAT_RUN), "repeats")
        .when(stripped.rlike(r"\p{Lu}") & (F.upper(stripped) == stripped), "caps")
        .when(stripped.rlike("[A-Za-z]") & stripped.rlike(OTHER_SCRIPTS), "mixed_script")
        .otherwise("plain")
    )


def edge_summary(moderated: DataFrame, text: str = "text") -> DataFrame:
    """Verdicts and warnings per kind of text."""
    return (
        moderated.groupBy(edge_kind(F.col(text)).alias("kind"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("verdict") == "toxic").alias("flagged"),
            F.count_if(F.size("warnings") > 0).alias("warned"),
        )
    )
