"""Exact calibration: every distinct score is a cut, however many there are.

The running counts behind the cuts come from a distributed prefix sum. Distinct scores are dealt to
ranges of (group, score), every range adds up its own rows, and the few totals of the ranges give each
the sum of those above it. A group with all the rows lies in as many ranges as there are tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden import config
from textwarden.operators.evaluate import ratio
from textwarden.util import materialise


def exact_cuts(df: DataFrame, by: str = "lang", score: str = "score", truth: str = "expected") -> DataFrame:
    """``by, threshold, tp, fp, fn, tn`` at every distinct score of a group, rows at the cut being hits.

    Rows without a score (null or NaN) or a truth do not count; rows without a group count under ``unknown``.
    """
    known = F.col(score).isNotNull() & ~F.isnan(score) & F.col(truth).isNotNull()
    group = F.coalesce(F.col(by), F.lit(config.UNKNOWN_LANGUAGE)).alias(by)
    positive = F.col(truth) == 1
    counts = (
        df.where(known)
        .groupBy(group, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    )
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(ranges, F.col(by), F.col("threshold").desc())
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()))

    # one row per group and range: groups plus ranges of them at most
    totals = dealt.groupBy(by, "_range").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    whole = Window.partitionBy(by)
    above = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = totals.select(
        by, "_range",
        F.coalesce(F.sum("_p").over(above), zero).alias("_above_p"), F.sum("_p").over(whole).alias("_all_p"),
        F.coalesce(F.sum("_n").over(above), zero).alias("_above_n"), F.sum("_n").over(whole).alias("_all_n"),
    )
    within = Window.partitionBy(by, "_range").orderBy(F.desc("threshold"))
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumns({"_pos": F.sum("_pos").over(within), "_neg": F.sum("_neg").over(within)})
    tp, fp = F.col("_above_p") + F.col("_pos"), F.col("_above_n") + F.col("_neg")
    return running.join(offsets, [by, "_range"]).select(
        by, "threshold", tp.alias("tp"), fp.alias("fp"), (F.col("_all_p") - tp).alias("fn"), (F.col("_all_n") - fp).alias("tn")
    )


def calibrate_exact(df: DataFrame, by: str = "lang", score: str = "score", truth: str = "expected") -> DataFrame:
    """``by, threshold, tp, fp, fn, tn, f1, separable``: per group the cut with the best F1 of all.

    A tie goes to the higher threshold. ``separable`` is false where no cut catches a larger share of toxic
    than of clean texts. A group without toxic rows gets its highest score.
    """
    f1 = ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    gain = ratio(F.col("tp"), F.col("tp") + F.col("fn")) - ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    best = F.max(F.struct(f1.alias("f1"), "threshold", "tp", "fp", "fn", "tn")).alias("_best")
    found = exact_cuts(df, by, score, truth).groupBy(by).agg(best, (F.max(gain) > 0).alias("separable"))
    names = ("threshold", "tp", "fp", "fn", "tn", "f1")
    return found.select(by, *[F.col(f"_best.{name}").alias(name) for name in names], "separable")
