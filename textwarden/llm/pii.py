"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags whitespace-separated words with ``TAGS``. Its features are word shapes (classes of
characters, runs collapsed, lengths of digit runs) of a word and its two neighbours, hashed. It is
trained on the driver from a small labelled table: lines of at most ``SAMPLE`` documents, labelled
by the fixed patterns, and copies of these lines in which a labelled span is written in a way the
patterns do not know. Texts are decoded by Viterbi in numpy batches.

Almost all words are tagged ``O`` whatever their neighbours are: where the other tags' emissions
are behind by more than all transitions together could make up, ``O`` is on the best path. Such words
cut the text into short stretches, and only these are decoded; the result is the exact best path.
A stretch the field tags is cut at line ends and fixed matches; what counts in it is every datum that passes
the checks of its kind.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *KINDS)
SAMPLE = 200
"""Bound of the labelled table: documents whose lines are in it."""

SAMPLE_CHARS = 20_000
"""Longer documents are not taken into the labelled table (they are searched like all others)."""

SHAPES = 1 << 12
TRAIN_WORDS = 120
BATCH_BYTES = 1 << 20

# --- Fixed patterns -------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their ``@``, which no other part can hold."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", found.end() if found else at + 1)


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by kind and start, in code points."""
    found = [(0, *span) for span in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                found.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = digits_of(m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                found.append((3, *m.span()))
    return found


# --- Shapes ---------------------------------------------------------------------------

BLANK = 1
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b in (0x20, 9, 10, 11, 12, 13):
        _CLASS[_b] = BLANK
    elif _b >= 128 or _c.islower():
        _CLASS[_b] = 2
    elif _c.isupper():
        _CLASS[_b] = 3
    elif _c.isdigit():
        _CLASS[_b] = 4
    else:
        _CLASS[_b] = 5 + _b % 64
_LENGTH = np.array([0, 1, 2, 3, 4, 5, *[6] * 8, *[7] * 6, 8], np.uint32)  # buckets of digit runs
_POWERS = np.array([pow(0x9E3779B1, i, 1 << 32) for i in range(64)], np.uint32)


def shapes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and hashed shapes of the words of ``data``."""
    kind = _CLASS[np.frombuffer(data, np.uint8)]
    if not len(kind):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    length = np.diff(np.append(first, len(kind)))
    of = kind[first]
    solid = of != BLANK
    opens = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))  # first run of a word
    if not len(opens):
        return (np.zeros(0, np.int64),) * 3
    closes = np.flatnonzero(solid & np.concatenate((~solid[1:], [True])))
    code = of.astype(np.uint32) * 16 + np.where(of == 4, _LENGTH[np.minimum(length, 20)], 0).astype(np.uint32)
    word = np.cumsum(solid & np.concatenate(([True], ~solid[:-1]))) - 1
    place = np.minimum(np.arange(len(first)) - opens[np.maximum(word, 0)], 63)
    code = np.where(solid, code * _POWERS[np.maximum(place, 0)], 0).astype(np.uint32)
    hashed = np.add.reduceat(code, opens) * np.uint32(0x85EBCA6B)
    shape = (hashed >> np.uint32(20)).astype(np.int64) % (SHAPES - 1) + 1  # 0: beyond the text
    return first[opens], first[closes] + length[closes], shape


# --- The field ------------------------------------------------------------------------


@dataclass
class Field:
    """Emission tables ``[3, SHAPES, tags]`` for a word's own, last and next shape; transitions."""

    emit: np.ndarray
    move: np.ndarray
    bias: np.ndarray

    def emissions(self, own: np.ndarray, last: np.ndarray, following: np.ndarray) -> np.ndarray:
        return self.emit[0][own] + self.emit[1][last] + self.emit[2][following] + self.bias


def neighbours(shape: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes before and after every word; 0 where a text (starting at word ``starts``) ends."""
    last = np.concatenate(([0], shape[:-1]))
    following = np.concatenate((shape[1:], [0]))
    begins = starts[starts < len(shape)]
    last[begins] = 0
    following[begins[begins > 0] - 1] = 0
    return last, following


def viterbi(field: Field, emissions: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best tags of stretches of words, each between two words tagged ``O``, all at once."""
    tags = np.zeros(len(emissions), np.int8)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    if not len(first):
        return tags
    back, score = [], field.move[0] + emissions[first]
    scores = [score]
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t, "left"))  # stretches longer than t
        paths = score[:n, :, None] + field.move[None]
        back.append(paths.argmax(axis=1).astype(np.int8))
        score = paths.max(axis=1) + emissions[first[:n] + t]
        scores.append(score)
    best = np.zeros(len(first), np.int64)
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t, "left"))
        longer = int(np.searchsorted(-length, -(t + 1), "left"))
        best[longer:n] = (scores[t][longer:n] + field.move[:, 0]).argmax(axis=1)
        if longer:
            best[:longer] = back[t][np.arange(longer), best[:longer]]
        tags[first[:n] + t] = best[:n]
    return tags


def decode(field: Field, shape: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Best tag of every word of several texts, whose first words are ``starts``."""
    if not len(shape):
        return np.zeros(0, np.int8)
    last, following = neighbours(shape, starts)
    emissions = field.emissions(shape, last, following)
    others = emissions[:, 1:].max(axis=1)
    # what a tag's two transitions can win over those of O
    win = (field.move[:, 1:].T[:, :, None] + field.move[1:, None, :]) - (field.move[:, 0][:, None] + field.move[0][None, :])
    open_ = ~(emissions[:, 0] - others > max(0.0, float(win.max())))
    edge = np.zeros(len(shape) + 1, bool)
    edge[starts] = True
    begins = np.flatnonzero(open_ & (edge[:-1] | np.concatenate(([True], ~open_[:-1]))))
    ends = np.flatnonzero(open_ & (edge[1:] | np.concatenate((~open_[1:], [True]))))
    return viterbi(field, emissions, begins, ends - begins + 1)


def train(lines: list[tuple[np.ndarray, np.ndarray]], steps: int = 80, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; ``lines`` are (shapes, tags), cut to ``TRAIN_WORDS`` words."""
    parts = [
        (shape[at : at + TRAIN_WORDS], tag[at : at + TRAIN_WORDS])
        for shape, tag in lines
        for at in range(0, len(shape), TRAIN_WORDS)
    ]
    k = len(TAGS)
    field = Field(np.zeros((3, SHAPES, k)), np.zeros((k, k)), np.zeros(k))
    field.bias[0] = 4.0
    parts.sort(key=lambda p: -len(p[0]))
    if not parts:
        return field
    length = np.array([len(s) for s, _ in parts])
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    own = np.concatenate([s for s, _ in parts])
    gold = np.concatenate([t for _, t in parts]).astype(np.int64)
    last, following = neighbours(own, first)
    sides = (own, last, following)
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]
    one_hot = np.eye(k)[gold]
    before = np.concatenate(([0], gold[:-1]))
    before[first] = 0
    gold_move = np.zeros((k, k))
    np.add.at(gold_move, (before, gold), 1.0)
    np.add.at(gold_move, (gold[first + length - 1], 0), 1.0)
    tables = [field.emit, field.move, field.bias]
    momentum, scale = [np.zeros_like(t) for t in tables], [np.zeros_like(t) for t in tables]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        emissions = field.emissions(*sides)
        forth = np.zeros_like(emissions)
        forth[first] = field.move[0] + emissions[first]
        for t in range(1, len(alive)):
            rows = first[: alive[t]] + t
            forth[rows] = total(forth[rows - 1][:, :, None] + field.move[None], 1) + emissions[rows]
        whole = total(forth[first + length - 1] + field.move[:, 0], 1)
        back = np.zeros_like(emissions)
        back[first + length - 1] = field.move[:, 0]
        moves = np.zeros((k, k))
        for t in range(len(alive) - 1, 0, -1):
            rows = first[: alive[t]] + t
            ahead = emissions[rows] + back[rows]
            joint = forth[rows - 1][:, :, None] + field.move[None] + ahead[:, None, :]
            moves += np.exp(joint - whole[: alive[t], None, None]).sum(axis=0)
            back[rows - 1] = total(field.move[None] + ahead[:, None, :], 2)
        share = np.exp(forth + back - np.repeat(whole, length)[:, None])
        moves[0] += share[first].sum(axis=0)
        moves[:, 0] += share[first + length - 1].sum(axis=0)
        gap = one_hot - share
        n = len(own)
        slopes = [np.zeros_like(field.emit), (gold_move - moves) / n, gap.sum(axis=0) / n]
        for side, ids in enumerate(sides):
            for tag in range(k):
                slopes[0][side, :, tag] = np.bincount(ids, gap[:, tag], SHAPES) / n
        for table, slope, m, v in zip(tables, slopes, momentum, scale):
            slope = slope - ridge / n * table
            m *= 0.9
            m += 0.1 * slope
            v *= 0.99
            v += 0.01 * slope**2
            table += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


# --- The labelled table ---------------------------------------------------------------


def rewritten(kind: int, text: str) -> list[str]:
    """The same datum in writings that the fixed patterns do not know."""
    if kind == 0:
        name, _, host = text.partition("@")
        return [f"{name} (at) {host}", f"{name}[at]{host}", f"{name} [at] {host}"]
    digits = digits_of(text)
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours)]
    if kind == 3 and len(digits) >= 10:
        area, middle, end = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({area}) {middle}-{end}", f"{area}-{middle}-{end}", f"{area}.{middle}.{end}"]
    return []


def labelled(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and tags of a line's words; a word that meets a span has its tag."""
    data = text.encode("utf-8", "replace")
    starts, ends, shape = shapes(data)
    tags = np.zeros(len(shape), np.int64)
    for kind, i, j in spans:
        a, b = len(text[:i].encode()), len(text[:j].encode())
        tags[(starts < b) & (ends > a)] = kind + 1
    return shape, tags


def labelled_lines(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The labelled table: every line of the texts, and its rewritten copies."""
    rows = []
    for text in texts:
        for line in text.split("\n"):
            spans = fixed_spans(line)
            rows.append(labelled(line, spans))
            for kind, i, j in spans:
                for other in rewritten(kind, line[i:j]):
                    shift = len(other) - (j - i)
                    moved = [(kind, i, i + len(other))] + [
                        (c, a + shift * (a >= j), b + shift * (a >= j)) for c, a, b in spans if b <= i or a >= j
                    ]
                    rows.append(labelled(line[:i] + other + line[j:], moved))
    return [row for row in rows if len(row[0])]


def sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most ``most`` different texts that hold a digit or an ``@``, those of least hash."""
    rows = docs.where(F.col("text").rlike("[@0-9]") & (F.length("text") <= SAMPLE_CHARS)).select(
        "text", F.xxhash64("text").alias("hash")
    )
    least = [r["hash"] for r in rows.select("hash").distinct().orderBy("hash").limit(most).collect()]
    if not least:
        return []
    found = rows.where(F.col("hash").isin(least)).dropDuplicates(["hash"]).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["hash"])]


def learn(docs: DataFrame, most: int = SAMPLE) -> Field:
    return train(labelled_lines(sample(docs, most)))


# --- Search ---------------------------------------------------------------------------

ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[(\[]\s?at\s?[)\]])\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[+(]?[0-9][0-9().\x20/+-]*[0-9]")
MOST_DIGITS = 19
"""Most digits of a datum."""



PIECE = re.compile(r"[^\x20/]+")
CUT = re.compile(r"[\r\n]+")


def fits(kind: int, datum: str) -> bool:
    digits = digits_of(datum)
    if kind == 1:
        parts = re.split(r"[^0-9]+", datum.strip("+()"))
        return len(parts) == 4 and all(p and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15 and len(digits) < len(datum)
    return True


def plausible(kind: int, text: str) -> Iterator[tuple[int, int]]:
    """The parts of a tagged stretch that are data of its kind: matches of the kind's pattern, and where a
    match fails its check, the first and shortest runs of its words (cut at blanks and slashes) that pass."""
    for found in (ADDRESS if kind == 0 else NUMBER).finditer(text):
        if fits(kind, found.group()):
            yield found.span()
            continue
        words = [(found.start() + m.start(), found.start() + m.end()) for m in PIECE.finditer(found.group())]
        # a run begins and ends at words with digits
        words = [(a, b, n) for a, b in words if (n := len(digits_of(text[a:b])))]
        i = 0
        while i < len(words):
            digits = 0
            for j in range(i, len(words)):
                digits += words[j][2]
                if digits > MOST_DIGITS:
                    break
                part = NUMBER.fullmatch(text, words[i][0], words[j][1])
                if part and fits(kind, part.group()):
                    yield part.span()
                    i = j
                    break
            i += 1


def free(text: str, start: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of ``text``, which begins at ``start``, between line ends and the ``taken`` spans (sorted)."""
    blocks = [m.span() for m in CUT.finditer(text)]
    at = bisect.bisect_right(taken, start, key=lambda span: span[1])
    while at < len(taken) and taken[at][0] < start + len(text):
        blocks.append((taken[at][0] - start, taken[at][1] - start))
        at += 1
    end = 0
    for i, j in sorted(blocks):
        if i > end:
            yield end, i
        end = max(end, j)
    if end < len(text):
        yield end, len(text)


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that spans of all kinds take, sorted and without overlaps."""
    out: list[tuple[int, int]] = []
    for i, j in sorted((i, j) for _, i, j in spans):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def added_spans(
    field: Field, texts: list[str], fixed: list[list[tuple[int, int, int]]]
) -> list[list[tuple[int, int, int]]]:
    """What the field adds to the fixed spans of several texts, in code points."""
    data = [text.encode("utf-8", "replace") for text in texts]
    joined = b"\n".join(data)
    begins = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])[:-1])).astype(np.int64)
    first, last, shape = shapes(joined)
    starts = np.unique(np.searchsorted(first, begins))
    tags = decode(field, shape, starts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hits = np.flatnonzero(tags)
    if not len(hits):
        return out
    taken = [apart(spans) for spans in fixed]
    owner = np.searchsorted(begins, first[hits], "right") - 1
    new = np.concatenate(
        ([True], (np.diff(hits) != 1) | (tags[hits][1:] != tags[hits][:-1]) | (owner[1:] != owner[:-1]))
    )
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hits)) - 1
    for head, tail in zip(heads.tolist(), tails.tolist()):
        doc, kind = int(owner[head]), int(tags[hits[head]]) - 1
        a, b = int(first[hits[head]] - begins[doc]), int(last[hits[tail]] - begins[doc])
        stretch = data[doc][a:b].decode("utf-8", "replace")
        at = len(data[doc][:a].decode("utf-8", "replace"))
        for i, j in free(stretch, at, taken[doc]):
            out[doc] += [(kind, at + i + x, at + i + y) for x, y in plausible(kind, stretch[i:j])]
    return out


SPAN = (
    T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("fixed", "boolean")
)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of ``docs(text, ...)`` plus ``_pii``: the spans of the whole text, by
    kind and start, in code points with exclusive end; ``fixed`` tells the patterns' from the
    field's. Null, empty and blank texts have none. A column ``_pii`` is replaced."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("fixed", pa.bool_())])
    docs = docs.drop("_pii")
    schema = T.StructType([*docs.schema.fields]).add("_pii", T.ArrayType(SPAN))

    def spans(texts: list[str]) -> list[list[dict]]:
        fixed = [fixed_spans(text) for text in texts]
        rows = []
        for known, more in zip(fixed, added_spans(field, texts, fixed)):
            both = sorted([(*s, True) for s in known] + [(*s, False) for s in more])
            rows.append([{"kind": KINDS[c], "start": i, "end": j, "fixed": sure} for c, i, j, sure in both])
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, part, size = [], [], 0
            for text in batch.column("text"):
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size >= BATCH_BYTES:
                    found += spans(part)
                    part, size = [], 0
            found += spans(part) if part else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(span))], [*batch.schema.names, "_pii"]
            )

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
