"""Scores, flags and verdicts as Column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import config
from textwarden.functions.language import alias_of, literal_map, quoted

TOXIC = "toxic"


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def softmax(logits: Column) -> Column:
    """Softmax over an array of logits, shifted by the maximum so that it cannot overflow."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def logit_milli(hits: str, bias: int, weights: Mapping[str, int]) -> Column:
    """Exact integer logit in thousandths of the array column ``hits``: bias plus one weight
    per occurrence of a word."""
    if not weights:
        return F.lit(bias)
    words = quoted(weights)
    pairs = ", ".join(f"{quoted([word])}, {int(weight)}" for word, weight in weights.items())
    return F.expr(
        f"aggregate(filter({hits}, t -> t in ({words})), {int(bias)}, (sum, t) -> sum + map({pairs})[t])"
    )


def label_logits(hits: str, model: config.LinearModel) -> dict[str, Column]:
    return {
        label: logit_milli(hits, model.bias[label], model.weights.get(label, {})) / 1000.0
        for label in model.labels
    }


def label_scores(hits: str, model: config.LinearModel) -> dict[str, Column]:
    """Unrounded score per label; labels are independent (no softmax)."""
    return {label: sigmoid(logit) for label, logit in label_logits(hits, model).items()}


def pick_label(scores: Column, label: str = TOXIC) -> Column:
    """Score of a label in a map, compared without case; 0.0 when it is missing."""
    found = F.map_filter(scores, lambda name, _: F.lower(name) == label.lower())
    return F.coalesce(F.try_element_at(F.map_values(found), F.lit(1)), F.lit(0.0))


def top_label(scores: Mapping[str, Column]) -> Column:
    """Name of the best label; the earlier label wins a tie."""
    best = max_score(scores)
    names = [F.when(score == best, F.lit(label)) for label, score in scores.items()]
    return F.coalesce(*names)


def max_score(scores: Mapping[str, Column]) -> Column:
    columns = list(scores.values())
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def flags(
    scores: Mapping[str, Column],
    threshold: Column,
    per_label: Column | None = None,
    other: float | None = config.OTHER_LABEL_THRESHOLD,
) -> dict[str, Column]:
    """Flag per label, decided on the unrounded score.

    The toxic label uses ``threshold``; the others use ``other``, or ``threshold`` as well
    when ``other`` is None (uniform rule). ``per_label`` is an optional map column whose
    entries beat both.
    """
    result = {}
    for label, score in scores.items():
        base = threshold if label == TOXIC or other is None else F.lit(other)
        limit = base if per_label is None else F.coalesce(per_label[label], base)
        result[label] = score >= limit
    return result


def categories(scores: Mapping[str, Column], flagged: Mapping[str, Column]) -> Column:
    """``map<label, struct<score, flagged>>`` with scores rounded to four digits."""
    parts = []
    for label, score in scores.items():
        entry = F.struct(F.round(score, 4).alias("score"), flagged[label].alias("flagged"))
        parts += [F.lit(label), entry]
    return F.create_map(*parts)


def binary_verdict(flag: Column) -> Column:
    return F.when(flag, "toxic").otherwise("clean")


def any_flag(flagged: Mapping[str, Column]) -> Column:
    result = F.lit(False)
    for flag in flagged.values():
        result = result | flag
    return result


def flagged_names(categories_col: Column, empty: str = "none") -> Column:
    """Names of the flagged categories, joined, or ``none``."""
    hit = F.map_keys(F.map_filter(categories_col, lambda _, c: c["flagged"]))
    return F.when(F.size(hit) == 0, F.lit(empty)).otherwise(F.array_join(hit, ", "))


def route(score: Column) -> tuple[Column, Column]:
    """Three-way verdict and its confidence word, from a score rounded to four digits."""
    verdict = (
        F.when(score >= config.TOXIC_CUT, "toxic")
        .when(score >= config.REVIEW_CUT, "needs_review")
        .otherwise("clean")
    )
    certainty = F.when((score >= config.REVIEW_CUT) & (score < config.TOXIC_CUT), "uncertain").otherwise(
        "high"
    )
    return verdict, certainty


def threshold_for(language: Column, settings: config.Settings) -> Column:
    """Alias, then the language's threshold, then the default."""
    known = literal_map({lang: float(t) for lang, t in settings.thresholds.items()})
    return F.coalesce(known[alias_of(language, settings)], F.lit(float(settings.default_threshold)))
