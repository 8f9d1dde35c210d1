"""Settings, lexicon and language profiles: plain values and small frozen classes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# --- Fixed values: these must equal the reference's for right results. ---------------

LANGUAGE_NAMES = {"en": "English", "hi": "Hindi", "ar": "Arabic", "es": "Spanish"}

LANGUAGE_ALIASES = {
    "mr": "hi",
    "ne": "hi",
    "ur": "ar",
    "fa": "ar",
    "ca": "es",
    "pt": "es",
    "gl": "es",
}

LANGUAGE_THRESHOLDS = {"en": 0.5, "hi": 0.15, "ar": 0.20, "es": 0.5}
DEFAULT_THRESHOLD = 0.5
OTHER_LABEL_THRESHOLD = 0.5
FALLBACK_LANGUAGE = "en"
UNKNOWN_LANGUAGE = "unknown"

MIN_TEXT_CHARS, MAX_TEXT_CHARS = 1, 5000
MIN_BATCH_TEXTS, MAX_BATCH_TEXTS = 1, 100
MIN_WORDS = 3
MAX_MODEL_TOKENS = 512

REVIEW_CUT, TOXIC_CUT = 0.5, 0.85
SWEEP_GRID = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
HISTOGRAM_BINS = 10

TEXT_COLUMNS = ("text", "content", "message", "comment")

BLANK_WARNING = "Text is empty or whitespace-only — skipped classification"
SHORT_WARNING = "Short text (%d words) — classification may be unreliable"
SHORT_NOTE = "Text too short for reliable classification"

# Cell contents that pandas' CSV reader takes for missing (its documented default set).
CSV_NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Own defaults: marker words per language and the keyword scorer. ------------------

MARKER_WORDS = {
    "en": "the of and to in that is for with as by was this are it",
    "de": "der die und den das von zu mit ist im auf dem nicht ein eine",
    "es": "de la que el en los las se del por un con una para es",
    "fr": "de la le et les des en un du une que est pour dans qui",
    "pt": "não uma com são mas isso também você muito ao da do em os",
    "ca": "amb és els però això aquest són una del per que",
    "gl": "unha non os das dos ao coa polo pola tamén máis do da",
}
DEFAULT_PROFILE = {lang: tuple(words.split()) for lang, words in MARKER_WORDS.items()}

# Logit = bias + sum of word weights, all in thousandths so that sums stay exact integers.
TOXIC_BIAS, NOT_TOXIC_BIAS = -3000, 2400
TOXIC_WORDS = (
    # words, weight on "toxic", weight on "not_toxic"
    ("trash clown idiot scum worthless moron pathetic loser stupid disgusting", 4000, -3900),
    ("stuupid bewakoof bakwas", 4000, -3900),
    ("idiota inútil estúpido estúpida basura imbécil", 4000, -3900),
    ("बेवकूफ बेकार घटिया", 2600, -2200),
    ("غبي أحمق عار", 2000, -1900),
)


@dataclass(frozen=True)
class LinearModel:
    """Two independent sigmoid labels over word weights (thousandths)."""

    bias: Mapping[str, int]
    weights: Mapping[str, Mapping[str, int]]

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(self.bias)

    @property
    def vocabulary(self) -> tuple[str, ...]:
        return tuple(sorted({word for per_label in self.weights.values() for word in per_label}))


def _keyword_model() -> LinearModel:
    rows = [(word, up, down) for words, up, down in TOXIC_WORDS for word in words.split()]
    return LinearModel(
        bias={"toxic": TOXIC_BIAS, "not_toxic": NOT_TOXIC_BIAS},
        weights={
            "toxic": {word: up for word, up, _ in rows},
            "not_toxic": {word: down for word, _, down in rows},
        },
    )


DEFAULT_MODEL = _keyword_model()


@dataclass(frozen=True)
class Settings:
    """Every option of a moderation run. Immutable; derive variants with ``override``."""

    thresholds: Mapping[str, float] = field(default_factory=lambda: dict(LANGUAGE_THRESHOLDS))
    default_threshold: float = DEFAULT_THRESHOLD
    other_label_threshold: float = OTHER_LABEL_THRESHOLD
    names: Mapping[str, str] = field(default_factory=lambda: dict(LANGUAGE_NAMES))
    aliases: Mapping[str, str] = field(default_factory=lambda: dict(LANGUAGE_ALIASES))
    fallback: str = FALLBACK_LANGUAGE
    min_words: int = MIN_WORDS

    @property
    def supported(self) -> tuple[str, ...]:
        return tuple(self.names)

    def override(self, values: Mapping[str, object]) -> Settings:
        """Apply ``threshold_<lang>`` / ``threshold_default`` entries, e.g. from ``os.environ``.

        Keys are matched without regard to case; other keys are ignored.
        """
        thresholds, default = dict(self.thresholds), self.default_threshold
        for key, value in values.items():
            prefix, _, lang = key.lower().partition("_")
            if prefix != "threshold":
                continue
            if lang == "default":
                default = float(value)
            elif lang in self.names:
                thresholds[lang] = float(value)
        return replace(self, thresholds=thresholds, default_threshold=default)


DEFAULT_SETTINGS = Settings()
