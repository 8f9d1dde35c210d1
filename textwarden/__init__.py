"""Text-safety analytics on Spark: DataFrames of texts in, DataFrames of verdicts out."""

from textwarden.config import DEFAULT_MODEL, DEFAULT_PROFILE, LinearModel, Settings
from textwarden.operators.language import detect_language, detect_with_confidence, learn_profile
from textwarden.operators.moderation import (
    batch_summary,
    display_rows,
    moderate,
    moderate_batches,
    moderate_safe,
)
from textwarden.operators.scoring import learn_weights, model_scores, score_by_join, score_columns
from textwarden.operators.validate import split_valid, validate, validate_batch

__all__ = [
    "DEFAULT_MODEL",
    "DEFAULT_PROFILE",
    "LinearModel",
    "Settings",
    "batch_summary",
    "detect_language",
    "detect_with_confidence",
    "display_rows",
    "learn_weights",
    "learn_profile",
    "moderate",
    "moderate_batches",
    "moderate_safe",
    "model_scores",
    "score_by_join",
    "score_columns",
    "split_valid",
    "validate",
    "validate_batch",
]
