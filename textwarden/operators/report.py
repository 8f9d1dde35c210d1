"""Metric reports: lines of a Markdown table, the nested metrics document, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions import text as T
from textwarden.util import settle

METRIC_FIELDS = ("accuracy", "precision", "recall", "f1", "tp", "fp", "fn", "tn", "total")

# The columns of the report table.
COLUMNS = ("Language", "Samples", "Accuracy", "Precision", "Recall", "F1 Score", "Avg Latency")


def report_header(metrics: DataFrame) -> tuple[str, str]:
    """The two header lines of the Markdown table; the latency column only if it was measured."""
    names = COLUMNS if "avg_latency_ms" in metrics.columns else COLUMNS[:-1]
    return (
        "| " + " | ".join(names) + " |",
        "|" + "|".join("-" * (len(name) + 2) for name in names) + "|",
    )


def report_lines(metrics: DataFrame, by: str = "lang", names: DataFrame | None = None) -> DataFrame:
    """One Markdown table line per metrics row: ``lang, line``.

    ``names`` (``code, name``) replaces codes by language names where it has them.
    """
    out = metrics
    label = F.col(by)
    if names is not None:
        out = metrics.join(names.withColumnRenamed("code", by), by, "left")
        label = F.coalesce(F.col("name"), F.col(by))
    shown = F.when(F.col(by) == "overall", F.lit("**Overall**")).otherwise(label)
    latency = []
    if "avg_latency_ms" in metrics.columns:
        ms = F.col("avg_latency_ms")
        latency = [F.when(ms.isNotNull(), F.concat(T.fixed(ms, 2), F.lit("ms"))).otherwise("-")]
    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            shown,
            F.col("total").cast("string"),
            T.percent(F.col("accuracy")),
            T.percent(F.col("precision")),
            T.percent(F.col("recall")),
            T.fixed(F.col("f1"), 2),
            *latency,
        ),
        F.lit(" |"),
    )
    return out.select(by, line.alias("line"))


def report_document(metrics: DataFrame, model: str, threshold: float, by: str = "lang") -> DataFrame:
    """One row with the run's metrics nested: ``model, threshold, per_language, overall``.

    It gathers metrics rows, of which there is one per language; text rows never come here.
    """
    fields = [name for name in (*METRIC_FIELDS, "avg_latency_ms") if name in metrics.columns]
    entry = F.struct(*[F.col(name) for name in fields])
    is_overall = F.col(by) == "overall"
    per_language = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(~is_overall, F.struct(F.col(by), entry))))
    )
    return metrics.agg(
        F.lit(model).alias("model"),
        F.lit(float(threshold)).alias("threshold"),
        per_language.alias("per_language"),
        F.first(F.when(is_overall, entry), ignorenulls=True).alias("overall"),
    )


def _first(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows: each task keeps its best ``n``, no full sort.

    Settled, since Spark would otherwise move work on the result below the limit, to all rows.
    """
    return settle(df.orderBy(*order).limit(n), *df.columns)


def head_preview(df: DataFrame, order: str, text: str = "text", n: int = 5) -> DataFrame:
    """The first rows in an explicit order."""
    return _first(df.select(order, text), [F.asc(order)], n)


def recent(df: DataFrame, order: str | list[str], n: int = 20) -> DataFrame:
    """The newest rows, newest first."""
    columns = [order] if isinstance(order, str) else order
    return _first(df, [F.desc(name) for name in columns], n)
