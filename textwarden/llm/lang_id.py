"""Language identification by hierarchical discrimination.

A first set of linear support vector machines tells the language family, a second one separates
the languages within the family, one against one. Features are the relative frequencies of byte
3- and 4-grams of the whole lower-cased text, hashed; prediction is a sum of weights over the text.

The machines are fitted on a bounded sample: ``PER_LANGUAGE`` different texts of each language, the
ones with the smallest text hashes. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.llm.common import bounded_batches

PER_LANGUAGE = 200
"""Bound of the training sample: texts of each language."""

BUCKETS = 1 << 12
RIDGE = 1e-3
PIECE = 1 << 20
UNDETERMINED = "und"

# Language families by ISO code. A code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}

_FOLD = bytearray(b" " * 256)
for _byte in range(256):
    if _byte >= 128 or chr(_byte).isalpha():
        _FOLD[_byte] = ord(chr(_byte).lower()) if _byte < 128 else _byte
_FOLD = bytes(_FOLD)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(piece: bytes, body: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-grams that start in the first ``body`` bytes of a folded text."""
    a = np.frombuffer(piece, np.uint8).astype(np.uint32)
    three = (a[:-2] << 16 | a[1:-1] << 8 | a[2:])[:body]
    four = (a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:])[:body]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    return (three * np.uint32(2654435761)) >> shift, (four * np.uint32(2246822519)) >> shift


def folded(text: str) -> bytes:
    """Lower-case Latin letters, one blank for any run without letters, blanks around."""
    data = np.frombuffer(b" " + text.encode("utf-8", "replace").translate(_FOLD) + b" ", np.uint8)
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data = data + capital.astype(np.uint8) * 32
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == 32) & (data[:-1] == 32)
    return data[~again].tobytes()


def pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of a whole text, in parts of bounded size; every gram is in one part."""
    data = folded(text)
    for at in range(0, len(data), PIECE):
        yield grams(data[at : at + PIECE + 3], PIECE)


def features(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS)
    for three, four in pieces(text):
        total += np.bincount(three, minlength=BUCKETS) + np.bincount(four, minlength=BUCKETS)
    return total / max(1.0, total.sum())


@dataclass
class Machine:
    """One linear machine: which of two classes, and how its margin becomes a probability."""

    first: str
    second: str
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    between: list[Machine] = field(default_factory=list)
    within: dict[str, list[Machine]] = field(default_factory=dict)

    @property
    def machines(self) -> list[Machine]:
        return self.between + [m for name in sorted(self.within) for m in self.within[name]]


def fit_machine(x: np.ndarray, y: np.ndarray, first: str, second: str) -> Machine:
    """Squared-hinge linear SVM, by Newton steps on the support vectors' Gram matrix, and a
    logistic curve over its margins."""
    scale = 1.0 / max(1e-12, float(np.sqrt((x**2).sum(axis=1)).mean()))
    z = np.hstack([x * scale, np.ones((len(x), 1))])
    gram = z @ z.T
    active = np.ones(len(y), bool)
    for _ in range(30):
        beta = np.zeros(len(y))
        k = gram[np.ix_(active, active)]
        beta[active] = np.linalg.solve(k + RIDGE * len(y) * np.eye(len(k)), y[active])
        margins = gram @ beta
        now = y * margins < 1
        if not now.any() or (now == active).all():
            break
        active = now
    w = z.T @ beta
    slope, shift = 4.0, 0.0
    truth = y > 0
    for _ in range(100):  # a few safe gradient steps; separable classes must not run off
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        slope = float(np.clip(slope - ((p - truth) * margins).mean(), 1.0, 20.0))
        shift = float(np.clip(shift - (p - truth).mean(), -5.0, 5.0))
    return Machine(first, second, w[:-1] * scale, float(w[-1]), slope, shift)


def fit(x: np.ndarray, langs: Sequence[str], families: dict[str, str] = FAMILIES) -> Model:
    """Fit all machines on feature rows and their languages."""
    names = np.array(langs, dtype=object)
    model = Model()
    for lang in sorted(set(langs)):
        model.families.setdefault(families.get(lang, lang), []).append(lang)
    family = np.array([families.get(lang, lang) for lang in langs], dtype=object)

    def against(labels: np.ndarray, first: str, second: str) -> Machine:
        rows = (labels == first) | (labels == second)
        return fit_machine(x[rows], np.where(labels[rows] == first, 1.0, -1.0), first, second)

    model.between = [against(family, *pair) for pair in combinations(sorted(model.families), 2)]
    for name, members in model.families.items():
        model.within[name] = [against(names, *pair) for pair in combinations(members, 2)]
    return model


def margins_of(texts: list[str], machines: list[Machine]) -> np.ndarray:
    """Margins, one row per text and one column per machine."""
    table = [np.ascontiguousarray(m.weights) for m in machines]
    out = np.zeros((len(texts), len(machines)))
    for row, text in enumerate(texts):
        n = 0
        for three, four in pieces(text):
            n += len(three) + len(four)
            for column, weights in enumerate(table):
                out[row, column] += weights.take(three).sum() + weights.take(four).sum()
        out[row] /= max(1, n)
    return out + np.array([m.bias for m in machines])


def _vote(classes: list[str], machines: list[Machine], margins: np.ndarray) -> tuple[str, float]:
    """Winner of one-against-one votes (ties: larger sum of margins, then code point order) and
    the product of its probabilities."""
    votes = dict.fromkeys(classes, 0)
    sums = dict.fromkeys(classes, 0.0)
    for m, margin in zip(machines, margins):
        votes[m.first if margin >= 0 else m.second] += 1
        sums[m.first] += margin
        sums[m.second] -= margin
    best = min(classes, key=lambda c: (-votes[c], -sums[c], c))
    score = 1.0
    for m, margin in zip(machines, margins):
        if best in (m.first, m.second):
            p = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))
            score *= p if best == m.first else 1 - p
    return best, float(score)


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    known = [i for i, text in enumerate(texts) if has_letter(text)]
    out = [(UNDETERMINED, 0.0)] * len(texts)
    if not model.families:
        return out
    margins = margins_of([texts[i] for i in known], model.machines)
    place, at = {}, len(model.between)
    for name in sorted(model.within):
        place[name] = slice(at, at + len(model.within[name]))
        at = place[name].stop
    for i, row in zip(known, margins):
        family, sure = _vote(sorted(model.families), model.between, row[: len(model.between)])
        lang, inside = _vote(model.families[family], model.within[family], row[place[family]])
        out[i] = (lang, sure * inside)
    return out


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is kept from learning; a null id is neither held out nor learned from."""
    rest = F.crc32(F.col(doc_id) if isinstance(doc_id, str) else doc_id).bitwiseAND(F.lit(3))
    return rest == 2


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(lang, hash, features)``: about ``per_language`` different texts of each language.

    Texts are counted by an approximate number of distinct hashes, which gives the hash below
    which enough texts lie; copies of a text count once.
    """
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id").cast("string"))
    ).select("lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("hash"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    below = F.lit(0)
    for lang, n in ((r["lang"], r["n"]) for r in counts):
        bound = min((1 << 63) - 1, int(1.3 * per_language / max(1, n) * (1 << 63)))
        below = F.when(F.col("lang") == lang, F.lit(bound)).otherwise(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
            columns = [batch.column("lang"), batch.column("hash"), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "hash", "features"])

    return rows.where(F.col("hash") <= below).mapInArrow(run, "lang string, hash bigint, features binary")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit the machines on ``docs(doc_id, text, lang)``, held-out documents left out."""
    seen: dict[str, dict[int, bytes]] = {}
    for row in training_rows(docs, per_language).collect():
        seen.setdefault(row["lang"], {})[row["hash"]] = row["features"]
    rows = [(lang, seen[lang][h]) for lang in sorted(seen) for h in sorted(seen[lang])[:per_language]]
    if not rows:
        return Model()
    x = np.vstack([np.frombuffer(f, np.float32) for _, f in rows]).astype(np.float64)
    return fit(x, [lang for lang, _ in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_lang_pred`` and ``_lang_score``, from ``text`` alone.

    Columns of these names are replaced. Texts that are null or have no letter are ``und`` with score 0, and so are all texts if there
    was nothing to learn from.
    """
    docs = docs.drop("_lang_pred", "_lang_score")
    schema = T.StructType([*docs.schema.fields]).add("_lang_pred", "string").add("_lang_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(batch.column("text").to_pylist(), model)
            columns = [
                *batch.columns,
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_lang_pred", "_lang_score"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows whose ``text`` has a letter, as :func:`identify` sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t.as_py()) for t in batch.column("text")], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
