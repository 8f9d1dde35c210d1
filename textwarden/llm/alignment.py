"""Cross-tokenizer alignment through inverted pair bitmaps.

Every text is encoded by two tokenizers, A and B. Where a token of A and one of B end at the same byte,
they are linked, and the text is cut there into groups. For each pair of linked ids the documents
that link it are kept as a bitmap: documents are gathered into blocks, and a block holds, for every pair,
one compressed bitmap of its documents (sorted 16-bit places, or plain bits where those are fewer
bytes). A document that links a pair ``m`` times has the bits of ``m - 1`` in further bitmaps, the multiplicity
planes. A task merges the bitmaps of its batches into those of the block; blocks have no document in
common, so the union of their bitmaps is their list and popcounts add up: the documents of a pair are
the popcount of its bitmaps, its links that plus the popcounts of its planes times their powers of two.

The bitmaps are the postings by which scores return: joined with the finished counts of the pairs,
they travel to their blocks and are added up there by document. Links themselves never travel; a pair
that a third of all links repeat is one bitmap per block.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import bounded_batches, stored

BLOCK_DOCS = 1 << 14
BLOCK_LINKS = 4_000_000
"""A block is full at so many documents (at most 65,536) or links, whichever comes first."""

TEXT_AT_ONCE = 200_000
"""Characters that go to a tokenizer at once; what it holds besides the ids is far larger than the text."""

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
"""A single blank between two characters that are none: a byte-level pre-token always begins there."""

WORDS_KNOWN = 1 << 19
LONGEST_KNOWN = 64
"""About so many words are remembered, none of more characters."""

WORDS_AT_ONCE = 200


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library, special tokens as plain text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the printable characters that stand for the 256 bytes: a byte that has none takes the next from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [byte for byte in range(256) if byte not in set(shown)]
        byte_of = {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(others)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, number in vocabulary.items():
            known = all(char in byte_of for char in piece)
            self.pieces[number] = bytes(byte_of[c] for c in piece) if known else piece.encode()
        # what may act beyond a word: other steps before the model, tokens that are matched in the plain text
        given = json.loads(definition)
        before = given.get("pre_tokenizer") or {}
        self.by_words = (
            given.get("normalizer") is None
            and (before.get("type"), before.get("use_regex", True)) == ("ByteLevel", True)
            and not before.get("add_prefix_space")
            and all(token["special"] for token in given.get("added_tokens") or ())
        )
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. Words between safe cuts are encoded once and remembered."""
        if not self.by_words:
            return self.encode_whole(texts)
        heads, words = [], []
        for text in texts:
            found = SAFE_CUT.split(text)
            head = found[0]
            if len(head) > 1 and head[0] == " " and not head[1].isspace():
                found[0], head = head[1:], ""  # like the others, which have lost their blank
            else:
                del found[0]
            heads.append(head)
            words.append(found)
        if len(self.known) > WORDS_KNOWN:
            self.known.clear()
        fresh = list(set().union(*words).difference(self.known))
        self.known.update(zip(fresh, self.encode_words([" " + word for word in fresh])))
        ids = [
            np.frombuffer(head + b"".join(map(self.known.__getitem__, found)), np.int32).astype(np.int64)
            for head, found in zip(self.encode_words(heads), words)
        ]
        for word in fresh:
            if len(word) > LONGEST_KNOWN:
                del self.known[word]
        return ids

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of every word as 32-bit numbers."""
        for some in slices(words):
            for encoding in self.tokenizer.encode_batch_fast(words[some], add_special_tokens=False):
                yield array("i", encoding.ids).tobytes()

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > TEXT_AT_ONCE:
                cut = SAFE_CUT.search(text, at + TEXT_AT_ONCE // 2)
                if cut is None:
                    break
                parts.append(text[at : cut.start()])
                owner.append(i)
                at = cut.start()
            parts.append(text[at:])
            owner.append(i)
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for some in slices(parts):
            done = self.tokenizer.encode_batch_fast(parts[some], add_special_tokens=False)
            for i, encoding in zip(owner[some], done):
                found[i].append(np.array(encoding.ids, np.int64))
        return [np.concatenate(ids) for ids in found]


class Pieces:
    """Tokenizer B: a sentencepiece model; it puts a space before the text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_words = self.splits(model)
        self.pieces = []
        for number in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(number)
            single = self.processor.is_byte(number)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if single else piece.replace("▁", " ").encode())

    @staticmethod
    def splits(model: bytes) -> bool:
        """Whether a text's pieces are those of its words, each behind a blank: merges that change no character,
        and no piece that goes on behind a blank."""
        from sentencepiece import sentencepiece_model_pb2

        given = sentencepiece_model_pb2.ModelProto.FromString(model)
        trained, normal = given.trainer_spec, given.normalizer_spec
        return (
            trained.model_type == trained.BPE
            and not trained.treat_whitespace_as_suffix
            and not normal.precompiled_charsmap
            and normal.add_dummy_prefix
            and normal.escape_whitespaces
            and not normal.remove_extra_whitespaces
            and not any("▁" in piece.piece.lstrip("▁") for piece in given.pieces)
            and all(piece.type not in (piece.USER_DEFINED, piece.UNUSED) for piece in given.pieces)
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for some in slices(texts):
            found += [np.array(ids, np.int64) for ids in self.processor.encode(texts[some], num_threads=1)]
        return found


def slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``TEXT_AT_ONCE`` characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= TEXT_AT_ONCE:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def digits(size: int) -> np.ndarray:
    """Decimal numbers below ``size`` as rows of bytes, zeros behind, and a free column for a separator."""
    width = len(str(max(size - 1, 0)))
    written = np.array([str(n) for n in range(size)], f"S{width}").view(np.uint8).reshape(size, width)
    return np.concatenate([written, np.zeros((size, 1), np.uint8)], axis=1)


class Aligner:
    """Both tokenizers with their tables; one per task."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.bytes_a, self.bytes_b = (np.array(t.pieces, object) for t in (self.a, self.b))
        self.size_a, self.size_b = (np.array([len(p) for p in t.pieces], np.int64) for t in (self.a, self.b))
        width = max(len(self.size_a), len(self.size_b))
        table = digits(width)
        self.long = (table != 0).sum(axis=1)
        self.digits_a, self.digits_b = table[: len(self.size_a)], table[: len(self.size_b)]
        self.by_words = self.a.by_words and self.b.by_words
        self.known: dict[str, tuple[bytes, bytes, int, int] | None] = {}

    def aligned(self, texts: list[str | None]) -> list[tuple[int, int, str, np.ndarray] | None]:
        """Numbers of tokens of A and of B, the digest of the groups and the links ``a << 32 | b`` of every text that has
        tokens.

        Both tokenizers begin a token at a safe cut, so a group ends there: the groups of a text are those of its words,
        which are aligned once and remembered. A text with a word that is not its tokens' bytes is aligned as a whole.
        """
        out: list = [None] * len(texts)
        split: dict[int, list[str]] = {}
        whole = []
        for i, text in enumerate(texts):
            if not text:
                continue
            try:
                text.encode()
            except UnicodeEncodeError:
                continue
            if self.by_words:
                split[i] = SAFE_CUT.split(text)
            else:
                whole.append(i)
        if len(self.known) > WORDS_KNOWN:
            self.known.clear()
        fresh = list(set().union(*split.values()).difference(self.known))
        edges = [word for word in fresh if word[0].isspace() or word[-1].isspace()]
        inner = list(set(fresh).difference(edges))
        for some in slices(inner):
            self.learn(inner[some])
        for word in edges:
            self.learn([word])
        for i, words in split.items():
            found = [self.known[word] for word in words]
            if None in found:
                whole.append(i)
                continue
            links, written, n_a, n_b = zip(*found)
            digest = hashlib.sha256(b";".join(written)).hexdigest()
            out[i] = sum(n_a), sum(n_b), digest, np.frombuffer(b"".join(links), np.int64)
        for word in fresh:
            if len(word) > LONGEST_KNOWN:
                del self.known[word]
        for i, pair in zip(whole, self.tokens([texts[i] for i in whole])):
            if pair is not None:
                last = self.groups(*pair)
                digest = hashlib.sha256(self.written(*pair, *last)).hexdigest()
                out[i] = len(pair[0]), len(pair[1]), digest, (pair[0][last[0]] << 32) | pair[1][last[1]]
        return out

    def learn(self, words: list[str]) -> None:
        """Remember the links, the written groups and the numbers of tokens of words, aligned as one sequence of tokens;
        None where the bytes of either's tokens are not those of a blank and the word. Several words are given to
        the tokenizers as texts, with the safe cuts between them; these have no blank at either end."""
        texts = [" ".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        ids_a = [e.ids for e in self.a.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.processor.encode(texts, num_threads=1)
        a, b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b))
        data = (" " + " ".join(words)).encode()
        ends = np.cumsum([len(word.encode()) + 1 for word in words])
        size_a, size_b = self.size_a[a], self.size_b[b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        upto_a, upto_b = (np.searchsorted(of, ends) + 1 for of in (ends_a, ends_b))
        right = (
            size_a.all() and size_b.all()
            and b"".join(self.bytes_a[a]) == data == b"".join(self.bytes_b[b])
            and np.array_equal(ends_a[upto_a - 1], ends) and np.array_equal(ends_b[upto_b - 1], ends)
        )
        if not right:
            if len(words) == 1:
                self.known[words[0]] = None
            else:
                self.learn(words[: len(words) // 2])
                self.learn(words[len(words) // 2 :])
            return
        last_a, last_b = self.groups(a, b)
        groups = np.searchsorted(last_a, upto_a - 1) + 1
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        links = ((a[last_a] << 32) | b[last_b]).tobytes()
        written = self.written(a, b, last_a, last_b)
        # every token is written with one separator
        long_a, long_b = np.cumsum(self.long[a] + 1), np.cumsum(self.long[b] + 1)
        upto = (long_a[upto_a - 1] + long_b[upto_b - 1]).tolist()
        at = begin = 0
        for word, group, to, tokens_a, tokens_b in zip(words, (8 * groups).tolist(), upto, n_a.tolist(), n_b.tolist()):
            self.known[word] = links[at:group], written[begin : to - 1], tokens_a, tokens_b
            at, begin = group, to

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for every text; none where the text is null or empty, where it can't be written as
        UTF-8, or where the bytes of either's tokens are not those of a space and the text."""
        out: list = [None] * len(texts)
        kept, plain = [], []
        for i, text in enumerate(texts):
            try:
                data = b" " + (text or "").encode()
            except UnicodeEncodeError:
                continue
            if text:
                kept.append(i)
                plain.append(data)
        chosen = [texts[i] for i in kept]
        found = zip(kept, plain, self.a.encode([" " + t for t in chosen]), self.b.encode(chosen))
        for i, data, a, b in found:
            if b"".join(self.bytes_a[a]) == data == b"".join(self.bytes_b[b]):
                if self.size_a[a].all() and self.size_b[b].all():
                    out[i] = a, b
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the last token of A and of B in every group."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        return last_a, last_b

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of all groups."""
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        before = np.concatenate(([0], last_b + 1))
        place_a = np.arange(len(a)) + before[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1
        out = np.empty((len(a) + len(b), self.digits_a.shape[1]), np.uint8)
        out[place_a], out[place_b] = self.digits_a[a], self.digits_b[b]
        out[:, -1] = ord(",")
        out[place_a[last_a], -1] = ord("|")
        out[place_b[last_b], -1] = ord(";")
        out[-1, -1] = 0
        return out[out != 0].tobytes()


ROWS = (
    "block bigint, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " a int, b int, plane int, docs bigint, dense boolean, bitmap binary"
)
TYPES = (
    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(),
)
NAMES = [column.split()[0] for column in ROWS.split(",")]
OF_DOCUMENT = NAMES[1:8]
PRESENT = -1
"""In the column ``plane``: the bitmap of a pair's documents; others hold a bit of their multiplicity."""

ROWS_AT_ONCE = 50_000


def batch_of(size: int, **columns: object) -> pa.RecordBatch:
    """A batch of :data:`ROWS`; columns not given are null."""
    full = [
        columns[n] if isinstance(columns.get(n), pa.Array) else pa.array(columns[n], t) if n in columns else pa.nulls(size, t)
        for n, t in zip(NAMES, TYPES)
    ]
    return pa.RecordBatch.from_arrays(full, NAMES)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings cut out of one buffer at ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


def bitmaps(block: int, plane: int, pairs: np.ndarray, places: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """One compressed bitmap for every pair of the postings ``(pair, place)``, sorted by pair and place."""
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    length = np.diff(np.concatenate((first, [len(pairs)])))
    dense = length * 16 > size
    for at in range(0, len(first), ROWS_AT_ONCE):
        for plain in (False, True):
            rows = at + np.flatnonzero(dense[at : at + ROWS_AT_ONCE] == plain)
            if not len(rows):
                continue
            n = length[rows]
            begin = np.cumsum(n) - n
            chosen = places[np.repeat(first[rows] - begin, n) + np.arange(n.sum())]
            if plain:
                bits = np.zeros((len(rows), size), np.uint8)
                bits[np.repeat(np.arange(len(rows)), n), chosen] = 1
                data = np.packbits(bits, axis=1)
                ends = np.arange(1, len(rows) + 1) * data.shape[1]
            else:
                data, ends = chosen.astype("<u2"), np.cumsum(n) * 2
            key, same = pairs[first[rows]], np.ones(len(rows), np.int64)
            yield batch_of(
                len(rows), block=same * block, a=key >> 32, b=key & 0xFFFFFFFF, plane=same * plane,
                docs=n, dense=same == plain, bitmap=binaries(data, ends),
            )


def postings(block: int, found: list[tuple[np.ndarray, ...]], size: int) -> Iterator[pa.RecordBatch]:
    """Merge the postings ``(pairs, places, times)`` of a block's batches into its bitmaps and planes."""
    if not found:
        return
    pairs, places, times = (np.concatenate(column) for column in zip(*found))
    order = np.argsort(pairs, kind="stable")  # batches come in order of the places
    pairs, places, more = pairs[order], places[order], times[order] - 1
    yield from bitmaps(block, PRESENT, pairs, places, size)
    plane = 0
    while (more >> plane).any():
        bit = (more >> plane) & 1 == 1
        if bit.any():
            yield from bitmaps(block, plane, pairs[bit], places[bit], size)
        plane += 1


def encoded(docs: DataFrame, a: str, b: str, block_docs: int = BLOCK_DOCS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per document, with its place in its block, and a row per bitmap."""
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("places have 16 bits: a block holds up to 65,536 documents")
    with open(a, encoding="utf-8") as file:
        definition = file.read()
    with open(b, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        aligner = Aligner(definition, model)
        block, size, n_links = TaskContext.get().partitionId() << 32, 0, 0
        found: list[tuple[np.ndarray, ...]] = []
        for given in batches:
            ids, texts = given.column("doc_id"), given.column("text").to_pylist()
            for some in slices([text or "" for text in texts]):
                rows: list[tuple] = []

                def done() -> pa.RecordBatch:
                    columns = dict(zip(["block", *OF_DOCUMENT], zip(*rows)))
                    return batch_of(len(rows), **columns)

                for doc_id, pair in zip(ids[some.start : some.stop], aligner.aligned(texts[some])):
                    row = (0, 0, 0, 0, "")
                    if pair is not None:
                        n_a, n_b, digest, linked = pair
                        row = (n_a, n_b, len(linked), len(linked), digest)
                        keys, times = np.unique(linked, return_counts=True)
                        found.append((keys, np.full(len(keys), size, np.uint16), times.astype(np.int32)))
                        n_links += len(keys)
                    rows.append((block, size, doc_id.as_py(), *row))
                    size += 1
                    if size == block_docs or n_links >= block_links:
                        yield done()
                        yield from postings(block, found, size)
                        block, size, n_links, rows, found = block + 1, 0, 0, [], []
                if rows:
                    yield done()
        yield from postings(block, found, size)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Bitmap rows -> ``(a, b, n_docs, n_links, best)``: popcounts added up over blocks and planes.

    ``best`` tells whether no other A id has more links with the pair's B id. The largest counts are one
    row for every id of B's vocabulary, which bounds what is broadcast.
    """
    weight = F.expr("shiftleft(1L, greatest(plane, 0))")
    counts = rows.where("bitmap is not null").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == PRESENT, F.col("docs"))).alias("n_docs"),
        F.sum(weight * F.col("docs")).alias("n_links"),
    )
    counts = stored(counts, "pairs")
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(F.broadcast(most), "b").select(
        "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best")
    )


ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " n_best bigint, count_sum bigint"
)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, its bitmaps first: add their pairs' scores up at the places, then give out
    the documents."""
    block, total, best = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = [name.split()[0] for name in ALIGNED.split(", ")]

    def add(rows: pa.Table) -> None:
        n_links, is_best, plane = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("score", "best", "plane"))
        weight = np.left_shift(np.int64(1), np.maximum(plane, 0).astype(np.int64))
        dense = rows.column("dense").to_numpy(zero_copy_only=False).astype(bool)
        maps = rows.column("bitmap")
        for plain in (False, True):
            chosen = np.flatnonzero(dense == plain)
            lists = [np.frombuffer(maps[int(i)].as_buffer(), np.uint8) for i in chosen]
            if plain:
                lists = [np.flatnonzero(np.unpackbits(bits)) for bits in lists]
            elif lists:
                lists = [np.concatenate(lists).view("<u2")]
                sizes = np.array([len(maps[int(i)].as_buffer()) // 2 for i in chosen])
                np.add.at(total, lists[0], np.repeat((weight * n_links)[chosen], sizes))
                np.add.at(best, lists[0], np.repeat((weight * is_best)[chosen], sizes))
                continue
            for i, places in zip(chosen, lists):
                total[places] += weight[i] * n_links[i]
                best[places] += weight[i] * bool(is_best[i])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if blocks[i] != block:
                block, total, best = blocks[i], np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            part = table.slice(i, j - i)
            of_pair = part.column("bitmap").is_valid()
            pairs = part.filter(of_pair)
            if len(pairs):
                add(pairs)
            docs = part.filter(pa.compute.invert(of_pair))
            if len(docs):
                places = docs.column("place").to_numpy()
                columns = [docs.column(name) for name in names[:6]] + [pa.array(best[places]), pa.array(total[places])]
                for done in pa.table(columns, names).to_batches():
                    yield done


def align(docs: DataFrame, a: str, b: str, block_docs: int = BLOCK_DOCS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)``.

    ``a`` is the path of a byte-level BPE file, ``b`` that of a sentencepiece model. One row per input row;
    repeated rows and rows without an id count like others. ``n_links`` are the token pairs that end
    together, ``count_sum`` adds up how many links of all documents each of them has, ``n_best`` counts those
    with the most of all pairs of their B id, ties included. Texts that are null, empty, not to be written as
    UTF-8 (a lone surrogate) or that either tokenizer changes have no tokens: zeros and an empty
    ``groups_sha256``. A tokenizer whose tokens may have no bytes is taken to change the texts that hold them.
    """
    rows = stored(encoded(docs, a, b, block_docs, block_links), "alignment")
    scores = pair_counts(rows).select("a", "b", F.col("n_links").alias("score"), "best")
    narrow = rows.where("bitmap is not null").select("block", "a", "b", "plane", "dense", "bitmap")
    scored = narrow.join(scores, ["a", "b"]).drop("a", "b")
    documents = rows.where("bitmap is null").select("block", *OF_DOCUMENT)
    both = scored.unionByName(documents, allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("bitmap").isNull())
    return dealt.mapInArrow(_scores, ALIGNED)
