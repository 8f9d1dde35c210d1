"""Two scorers side by side: pairing, ensembles, comparison table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import config
from textwarden.operators.evaluate import ratio, with_metrics


def pair_results(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Join two stored result tables on their row key: ``key, expected, predicted_a, predicted_b``.

    Results belong together by key, not by position; ``key`` must identify a row. Only key and
    flags move. Scorers run over the same texts need no join: give both flags in one pass.
    """
    a = first.select(key, "expected", F.col("predicted").alias("predicted_a"))
    b = second.select(key, F.col("predicted").alias("predicted_b"))
    return a.join(b, key)


def ensemble(paired: DataFrame, first: str = "predicted_a", second: str = "predicted_b") -> DataFrame:
    """Confusion counts and metrics of both scorers, of "both agree" and of "either".

    All four are counted in one pass over the paired rows. A rule decides the rows that have all the
    predictions it needs; the others are ``undecided`` and not in ``total``.
    """
    a, b = F.col(first) == 1, F.col(second) == 1
    known = a.isNotNull() & b.isNotNull()
    rules = {"first": a, "second": b, "both": F.when(known, a & b), "either": F.when(known, a | b)}
    truth = F.col("expected") == 1
    columns = []
    for name, hit in rules.items():
        columns += [
            F.count_if(hit & truth).alias(f"{name}_tp"),
            F.count_if(hit & ~truth).alias(f"{name}_fp"),
            F.count_if(~hit & truth).alias(f"{name}_fn"),
            F.count_if(~hit & ~truth).alias(f"{name}_tn"),
            F.count(hit).alias(f"{name}_total"),
            F.count_if(hit.isNull()).alias(f"{name}_undecided"),
        ]
    row = paired.agg(*columns)
    counts = ("tp", "fp", "fn", "tn", "total", "undecided")
    points = [
        F.struct(F.lit(name).alias("model"), *[F.col(f"{name}_{count}").alias(count) for count in counts])
        for name in rules
    ]
    return with_metrics(row.select(F.inline(F.array(*points))))


MEASURES = (
    # The measures of the summary and their order.
    # measure, whether the smaller value is the better one (None: no winner)
    ("accuracy", False),
    ("false_positives", True),
    ("false_negatives", True),
    ("toxic_avg_score", None),
    ("clean_avg_score", True),
    ("separation", False),
)


def compare_models(
    df: DataFrame, models: Mapping[str, tuple[str, str]], by: str | None = None, overall: str = "overall"
) -> DataFrame:
    """Two scorers, measure by measure: ``metric, <first>, <second>, winner``.

    With ``by``, the same for every group and for all rows under the name ``overall``; rows
    without a group count under ``unknown``.

    ``models`` gives each scorer's columns for prediction and score; both are measured in one
    pass. ``separation`` is 1 if toxic texts score above clean ones on average, else 0. A scorer's accuracy
    is over the rows that it predicts.
    """
    if len(models) != 2:
        raise ValueError("compare exactly two scorers")
    truth = F.col("expected") == 1
    sums = []
    for i, (predicted, score) in enumerate(models.values()):
        hit = F.col(predicted) == 1
        sums += [
            F.count_if(truth == hit).alias(f"right_{i}"),
            F.count(predicted).alias(f"total_{i}"),
            F.count_if(hit & ~truth).alias(f"fp_{i}"),
            F.count_if(~hit & truth).alias(f"fn_{i}"),
            F.avg(F.when(truth, F.col(score))).alias(f"toxic_{i}"),
            F.avg(F.when(~truth, F.col(score))).alias(f"clean_{i}"),
        ]
    if by is None:
        row = df.agg(*sums)
    else:
        group = F.coalesce(F.col(by), F.lit(config.UNKNOWN_LANGUAGE))
        row = df.withColumn(by, group).rollup(by).agg(*sums)
        row = row.withColumn(by, F.coalesce(by, F.lit(overall)))

    def value(measure: str, i: int) -> Column:
        return {
            "accuracy": F.round(ratio(F.col(f"right_{i}"), F.col(f"total_{i}")), 4),
            "false_positives": F.col(f"fp_{i}").cast("double"),
            "false_negatives": F.col(f"fn_{i}").cast("double"),
            "toxic_avg_score": F.round(f"toxic_{i}", 4),
            "clean_avg_score": F.round(f"clean_{i}", 4),
            "separation": (F.col(f"toxic_{i}") > F.col(f"clean_{i}")).cast("double"),
        }[measure]

    first, second = models
    lines = []
    for measure, smaller_wins in MEASURES:
        a, b = value(measure, 0), value(measure, 1)
        if smaller_wins is None:
            winner = F.lit("-")
        else:
            ahead, behind = (a < b, b < a) if smaller_wins else (a > b, b > a)
            winner = F.when(ahead, first).when(behind, second).otherwise("-")
        lines.append(
            F.struct(
                F.lit(measure).alias("metric"),
                a.alias(first),
                b.alias(second),
                winner.alias("winner"),
            )
        )
    return row.select(*([by] if by else []), F.inline(F.array(*lines)))


def append_rows(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Add rows by column name; columns only one side has are null on the other."""
    return base.unionByName(extra, allowMissingColumns=True)
