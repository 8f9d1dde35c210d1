"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

Documents are cut into words at ASCII blanks, which no token of the vocabulary crosses. A task
gathers documents into blocks of about ``BLOCK_WORDS`` words and replaces every word by its number
in the block's list of distinct words. The lists of all blocks are dealt by a hash of the word, so
that each distinct word is in one group, where the tokenizer encodes it once; the ids go back to
the blocks by word, and inside a block to every position by number. Only distinct words of blocks
travel, packed; all numbers, those of the documents and those of the words of each hash, lie in a table bucketed
by block and do not move. A word
that makes up a third of all text is one entry per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.llm.common import bounded_batches, shared_path

BLOCK_WORDS = 1_400_000
PARTS = 256
"""Least number of groups the distinct words are dealt to; more if there are more shuffle partitions."""

BLOCK_DOCS = 1 << 16
ROWS_AT_ONCE = 1 << 12
IDS_AT_ONCE = 250_000
ENCODE_AT_ONCE = 1024


WORDS_AT_ONCE = 200_000


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII blanks. Plain ASCII ones are told apart in lower case only: the vocabulary's
    normalizer lower-cases, and added tokens, the one exception, hold ``<|``."""
    if text.isascii() and b"<|" not in text:
        return text.lower().split()
    return [word.lower() if word.isascii() and b"<|" not in word else word for word in text.split()]


class _Block:
    """The documents of a block: their ids and lengths, and their words as numbers in chunks, each with a
    dictionary of its own until the block is full. Words are Python objects for one chunk only."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.chunks: list[pa.DictionaryArray] = []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.waiting += words
        if len(self.waiting) >= WORDS_AT_ONCE:
            self.shut()

    def shut(self) -> None:
        self.chunks.append(pa.array(self.waiting, pa.binary()).dictionary_encode())
        self.waiting = []

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """Every word's number, and the different words by number."""
        if self.waiting or not self.chunks:
            self.shut()
        whole = pa.chunked_array(self.chunks).unify_dictionaries()
        return np.concatenate([chunk.indices.to_numpy() for chunk in whole.chunks]), whole.chunk(0).dictionary


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well: the high ones are almost all zero."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no line feed: it is one of the blanks they are cut at."""
    return zlib.compress(b"\n".join(words), 6)


def unpack_words(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b"\n")


BLOCKS = "block bigint, doc_id bigint, codes binary, part int, words binary, numbers binary"


def blocks(docs: DataFrame, parts: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> in one table, a row per document ``(block, doc_id, codes)`` and, for
    every block, its distinct words by the hash that deals them: ``(block, part, words, numbers)``."""
    names = [name.split()[0] for name in BLOCKS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def full(block: _Block) -> Iterator[pa.RecordBatch]:
            of = uuid.uuid4().int >> 65
            codes, forms = block.numbered()
            ends = np.cumsum(block.lengths).tolist()
            for at in range(0, len(ends), ROWS_AT_ONCE):
                some = range(at, min(at + ROWS_AT_ONCE, len(ends)))
                packed = (pack(codes[ends[i] - block.lengths[i] : ends[i]]) for i in some)
                yield batch([(of, block.doc_ids[i], data, None, None, None) for i, data in zip(some, packed)])
            dealt = np.fromiter((zlib.crc32(form.as_buffer()) % parts for form in forms), np.int64, len(forms))
            order = np.argsort(dealt, kind="stable")
            cuts = np.searchsorted(dealt[order], np.arange(parts + 1))
            for part, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    pairs = sorted(zip(forms.take(pa.array(order[i:j])).to_pylist(), order[i:j].tolist()))
                    numbers = pack(np.array([n for _, n in pairs]))
                    yield batch([(of, None, None, part, pack_words([w for w, _ in pairs]), numbers)])

        block, n = _Block(), 0
        for given in batches:
            for doc_id, text in zip(given.column("doc_id"), given.column("text")):
                split = words_of((text.as_py() or "").encode("utf-8", "replace"))
                block.add(doc_id.as_py(), split)
                n += len(split)
                if n >= block_words or len(block.lengths) >= BLOCK_DOCS:
                    yield from full(block)
                    block, n = _Block(), 0
        if block.lengths:
            yield from full(block)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BLOCKS)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Write a table to the shared folder in buckets, without a shuffle: every task writes a file for
    each bucket it has rows of. The session's catalog holds the table's name."""
    path = shared_path(df.sparkSession, "blocks")
    name = "textwarden_" + path.rpartition("-")[2]
    writer = df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", path)
    writer.saveAsTable(name, format="parquet")
    return df.sparkSession.table(name)


ENCODED = "of bigint, part int, lengths binary, ids binary"


def encode_words(listed: DataFrame, vocabulary: str) -> DataFrame:
    """``listed(block, part, words)`` -> per block and part, the words' ids.

    A group holds all blocks' words of one hash; each distinct one is encoded once.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = file.read()
    names = [name.split()[0] for name in ENCODED.split(", ")]
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(table: pa.Table) -> pa.Table:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, int] = {}
        places = [
            np.array([known.setdefault(word, len(known)) for word in unpack_words(words.as_py())])
            for words in table.column("words")
        ]
        distinct, flat, sizes = list(known), [], []
        for at in range(0, len(distinct), ENCODE_AT_ONCE):
            texts = [word.decode() for word in distinct[at : at + ENCODE_AT_ONCE]]
            for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                flat += found.ids
                sizes.append(len(found.ids))
        ids, length = np.array(flat, np.int64), np.array(sizes, np.int64)
        first = np.cumsum(length) - length
        rows = []
        for block, part, place in zip(table.column("block"), table.column("part"), places):
            n = length[place]
            rows.append((block.as_py(), part.as_py(), pack(n), pack(ids[spans(first[place], n)])))
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return listed.select("block", "part", "words").groupBy("part").applyInArrow(run, ENCODED)


def spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``first`` and are ``length`` long, one after another."""
    begin = np.cumsum(length) - length
    return np.repeat(first - begin, length) + np.arange(length.sum())


def _place(docs: pa.Table, words: pa.Table, table: pa.Table | None) -> Iterator[pa.Table]:
    """Join the ids of a block's words back to the positions of its documents, and with a ``table`` of pieces
    these to the ids."""
    listed = docs.filter(docs.column("numbers").is_valid())
    docs = docs.filter(docs.column("codes").is_valid())
    of_part = dict(zip(listed.column("part").to_pylist(), listed.column("numbers")))
    packed = (
        [of_part[part] for part in words.column("part").to_pylist()],
        words.column("lengths"),
        words.column("ids"),
    )
    numbers, sizes, lists = (
        np.concatenate([unpack(x.as_py()) for x in column] or [np.zeros(0, np.int64)]) for column in packed
    )
    start, length = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    start[numbers], length[numbers] = np.cumsum(sizes) - sizes, sizes
    flat = lists.astype(np.int32)
    doc_ids, out, counts = [], [], []

    def done() -> pa.Table:
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).astype(np.int32)))
        columns = {"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids}
        if table is not None:
            columns["decoded"] = pa.array(join_pieces(ids, table), pa.string())
        return pa.table(columns)

    total = 0
    for doc_id, codes in zip(docs.column("doc_id"), docs.column("codes")):
        code = unpack(codes.as_py())
        out.append(flat[spans(start[code], length[code])])
        doc_ids.append(doc_id.as_py())
        counts.append(len(out[-1]))
        total += counts[-1]
        if total >= IDS_AT_ONCE:
            yield done()
            doc_ids, out, counts, total = [], [], [], 0
    if doc_ids:
        yield done()


def encode(
    docs: DataFrame, vocabulary: str, block_words: int = BLOCK_WORDS, decoded: bool = False
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, ids)``, one row per input row, whole texts.

    The ids are those of the tokenizers library for the whole text without special tokens added;
    added tokens that stand in the text are recognised as the library does. Null and blank texts
    have no ids. Repeated rows and null ids are rows like others. ``vocabulary`` is the path of a
    tokenizer file whose tokens do not cross blanks and whose normalizer lower-cases.

    With ``decoded`` the rows also have that column, as :func:`decode` would add it: ids and pieces are joined
    by the task that has just placed the ids, which saves it a second Python worker.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(blocks(docs, max(PARTS, parts), block_words), "block", parts)
    ids = encode_words(rows.where("part is not null"), vocabulary)
    coded = rows.select("block", "doc_id", "codes", "part", "numbers")
    table = pieces(vocabulary) if decoded else None
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema([*fields, ("decoded", pa.string())] if decoded else fields)

    def place(docs: pa.Table, words: pa.Table) -> pa.Table:
        parts = list(_place(docs, words, table))
        # what earlier blocks have freed goes back before this one's rows are put together
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(parts).cast(schema) if parts else schema.empty_table()

    names = "doc_id bigint, ids array<int>" + (", decoded string" if decoded else "")
    return coded.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(place, names)


def pieces(vocabulary: str) -> pa.Table:
    """``(id, piece)`` of a tokenizer file, added tokens included; as long as the vocabulary."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    known = sorted((i, piece) for piece, i in tokenizer.get_vocab(with_added_tokens=True).items())
    return pa.table([pa.array([i for i, _ in known], pa.int64()), pa.array([p for _, p in known])], ["id", "piece"])


def join_pieces(lists: pa.ListArray, table: pa.Table) -> Iterator[str]:
    """The pieces of every list of ids, joined by blanks: the lists' different ids are joined to the table."""
    ends = lists.offsets.to_numpy()
    ids, place = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
    asked = pa.table([pa.array(ids, pa.int64())], ["id"])
    found = asked.join(table, "id", join_type="left outer", use_threads=False).sort_by("id")
    of_id = np.array(found.column("piece").to_pylist(), object)
    ends = (ends - ends[0]).tolist()
    for i, j in zip(ends, ends[1:]):
        yield " ".join(filter(None, of_id[place[i:j]]))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``IDS_AT_ONCE`` ids."""
    ends = batch.column("ids").fill_null([]).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + IDS_AT_ONCE)))
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded(..., ids)`` -> the same rows plus ``decoded``: their pieces joined by blanks.

    The different ids of every batch are joined to the table of pieces, whose size is the vocabulary's, by a
    hash join inside the task; the pieces go back to the ids' positions. That is what the library does for a
    vocabulary without a decoder. Unknown ids give no piece, null ids the empty text; a column
    ``decoded`` is replaced.
    """
    table = pieces(vocabulary)
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields]).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                lists = part.column("ids").fill_null([])
                decoded = pa.array(join_pieces(lists, table), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
