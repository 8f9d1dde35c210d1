"""Exact removal of repeated byte strings by sorting sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier in the corpus.

Sampling. Of every string of ``LENGTH`` bytes, the ``GRAM``-byte gram of least hash is its anchor (the
leftmost, if several). Equal strings have equal anchors at equal places, so repeats are found
by comparing anchors with equal hashes, and about 4 in 100 suffixes have to be looked at.

Copies. A document whose whole text is that of an earlier one goes whole, and nothing that it holds can
be the first of its kind: only the first of equal texts are looked at.

1. Anchors are dealt by hash; those whose hash occurs once end there. An anchor that a task has
   seen in two documents itself is known to repeat and is not dealt by its hash.
2. The others come with their context, all bytes that strings around the anchor can
   have: up to ``LENGTH`` from the anchor on and ``LENGTH - GRAM`` before it. Equal contexts are
   collapsed in the task that reads them: all but the earliest go whole.
3. Contexts are dealt by hash, and the suffixes (the bytes from the anchor on) of a block of hashes
   are put in order by deep-shallow sorting: multikey quicksort for the first ``GRAM`` bytes, eight bytes being
   one character, all open groups advancing together; then blind tries for the groups whose common
   prefix is longer. The reversed bytes before the anchors are put in order the same way. Two
   strings that begin ``o`` bytes before their anchors are equal if the suffixes share
   ``LENGTH - o`` bytes and the prefixes ``o``, which the two orders' common-prefix lengths
   tell as group numbers. All but the first string of a group repeat.
4. A hash with more than ``CLASS`` different contexts is not sorted in one task: its strings are
   told apart by a 128-bit hash and the earliest of each is found by an ordinary aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import bounded_batches, stored

LENGTH = 100
GRAM = 48
"""Longer grams make more anchors (2 in ``LENGTH - GRAM + 2`` bytes), but fewer that repeat by chance."""
BEFORE = LENGTH - GRAM
"""A string begins at most so many bytes before its anchor."""

CLASS = 50_000
CHUNK = 1 << 20
ANCHORS_AT_ONCE = 20_000
CONTEXTS_HELD = 50_000
ROWS_AT_ONCE = 100_000

_rng = np.random.default_rng(1)
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 63, 12, dtype=np.int64)]
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position on, by doubling."""
    power, width, h, made = BYTES[data], 1, None, 0
    for bit, step in enumerate(STEPS):
        if GRAM >> bit & 1:  # the gram is put together from the powers of two in its length
            h = power if h is None else power[: len(power) - made] * np.uint64(step) + h[width : width + len(power) - made]
            made += width
        if made == GRAM:
            break
        power = power[:-width] * np.uint64(step) + power[width:]
        width *= 2
    h = h[: len(data) - GRAM + 1].copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all strings inside the parts ``[begins, ends)`` of ``data`` (fewer than 2^24 bytes).

    Returns the anchors' places, hashes, the number of their part, and the first and last place
    at which a string with this anchor begins.
    """
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < LENGTH:
        return none
    h = gram_hashes(data)
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= BEFORE + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = BEFORE + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    count = np.maximum(ends - begins - LENGTH + 1, 0)
    if not count.sum():
        return none
    part = np.repeat(np.arange(len(begins)), count)
    first = np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at = (least[first] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
    last = np.append(new[1:], len(at)) - 1
    return at[new], h[at[new]].view(np.int64), part[new], first[new], first[last]


def chunks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid side by side: bytes, begin and end of the parts, their ids, and the place of a
    part in its text. A long text comes in parts that overlap so that each string is in one."""
    held, size = [], 0

    def laid() -> tuple:
        lengths = np.array([len(piece) for _, _, piece in held], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(piece for _, _, piece in held), np.uint8)
        ids = np.array([i for i, _, _ in held], np.int64)
        return data, ends - lengths, ends, ids, np.array([at for _, at, _ in held], np.int64)

    for key, text in rows:
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            piece = text[at : at + CHUNK + LENGTH - 1]
            held.append((key, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield laid()
                held, size = [], 0
    if held:
        yield laid()


def by_hash(columns: Iterator[list[np.ndarray]], least: int) -> Iterator[list[np.ndarray]]:
    """Cut batches in order of their first column where it changes, into blocks of ``least`` rows or
    more: rows of one hash stay together, and no more than a block and a batch is held."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in columns:
        if not len(batch[0]):
            continue
        held.append(batch)
        size += len(batch[0])
        if size < least:
            continue
        whole = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(whole[0], whole[0][-1]))  # where the last hash begins
        if cut:
            yield [x[:cut] for x in whole]
        held, size = [[x[cut:] for x in whole]], len(whole[0]) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for key, text in zip(batch.column("id"), batch.column("text")):
            yield key.as_py(), (text.as_py() or "").encode("utf-8", "replace")


# --- 1. Which anchors repeat ----------------------------------------------------------

ALONE, KNOWN, SPOKESMAN = 0, 1, 2


def found_anchors(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` -> ``(hash, id, state)``, one row per document and hash; a hash that
    occurs again within a chunk is ``KNOWN`` to repeat and sends one ``SPOKESMAN`` to its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, begins, ends, ids, _ in chunks(_texts(batches)):
            _, h, part, _, _ = anchors(data, begins, ends)
            values, group, n = np.unique(h, return_inverse=True, return_counts=True)
            key = ids[part]
            again = n[group] > 1
            order = np.lexsort((key, h))
            same = np.zeros(len(h), bool)
            same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
            sent = values[n > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((h[~same], sent))),
                    pa.array(np.concatenate((key[~same], np.zeros(len(sent), np.int64)))),
                    pa.array(np.concatenate((again[~same] * KNOWN, np.full(len(sent), SPOKESMAN))).astype(np.int8)),
                ],
                ["hash", "id", "state"],
            )

    return docs.select("id", "text").mapInArrow(run, "hash bigint, id bigint, state tinyint")


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``(id, hashes)``: for every document the anchor hashes that occur again, if any do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([b.column(i).to_numpy() for i in range(3)] for b in batches)
        for h, key, state in by_hash(columns, ROWS_AT_ONCE):
            yield _pairs(key[state == KNOWN], h[state == KNOWN])
            h, key, state = h[state != KNOWN], key[state != KNOWN], state[state != KNOWN]
            _, group, n = np.unique(h, return_inverse=True, return_counts=True)
            spoken = np.zeros(len(n), bool)
            spoken[group[state == SPOKESMAN]] = True
            hit = ((n > 1) | spoken)[group] & (state == ALONE)
            yield _pairs(key[hit], h[hit])

    dealt = F.when(F.col("state") == KNOWN, F.xxhash64("id", "hash")).otherwise(F.col("hash"))
    ordered = found_anchors(docs).repartition(dealt).sortWithinPartitions("hash")
    pairs = ordered.mapInArrow(run, "id bigint, hash bigint")
    return pairs.groupBy("id").agg(F.collect_set("hash").alias("hashes"))


def _pairs(key: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(h)], ["id", "hash"])


# --- 2. Contexts ----------------------------------------------------------------------

CONTEXT = "hash bigint, id bigint, at bigint, low int, high int, after binary, before binary"
"""``low`` to ``high``: how many bytes before the anchor its strings begin. ``before`` is reversed.
A row without ``after`` has been settled: its strings repeat."""


def _contexts(data: np.ndarray, begins, ends, at, part) -> tuple[np.ndarray, np.ndarray]:
    """Bytes after and before (reversed) anchors; zero beyond the text, where no string reaches."""
    after = at[:, None] + np.arange(LENGTH)
    before = at[:, None] - 1 - np.arange(BEFORE)
    size = len(data) - 1
    right = np.where(after < ends[part][:, None], data[np.minimum(after, size)], 0).astype(np.uint8)
    left = np.where(before >= begins[part][:, None], data[np.maximum(before, 0)], 0).astype(np.uint8)
    return right, left


def contexts(dirty: DataFrame) -> DataFrame:
    """``dirty(id, text, hashes)`` -> the contexts of the anchors with these hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = batch.column("id").to_numpy()
            wanted = batch.column("hashes")
            flat, ends = wanted.values.to_numpy(), wanted.offsets.to_numpy()
            sets = {int(k): np.sort(flat[i:j]) for k, i, j in zip(names, ends[:-1], ends[1:])}
            for data, begins, stops, ids, shift in chunks(_texts(iter([batch]))):
                at, h, part, first, last = anchors(data, begins, stops)
                if not len(at):
                    continue
                hit = np.zeros(len(at), bool)
                edges = np.searchsorted(part, np.arange(len(ids) + 1))
                for p, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                    if i < j:
                        mine = sets[int(ids[p])]
                        hit[i:j] = mine[np.minimum(np.searchsorted(mine, h[i:j]), len(mine) - 1)] == h[i:j]
                at, h, part, first, last = (x[hit] for x in (at, h, part, first, last))
                place = at - begins[part] + shift[part]
                for i in range(0, len(at), ANCHORS_AT_ONCE):
                    some = slice(i, i + ANCHORS_AT_ONCE)
                    right, left = _contexts(data, begins, stops, at[some], part[some])
                    yield from zip(
                        h[some].tolist(), ids[part[some]].tolist(), place[some].tolist(),
                        (at[some] - last[some]).tolist(), (at[some] - first[some]).tolist(),
                        map(bytes, right), map(bytes, left),
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name.split()[0] for name in CONTEXT.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        held: dict[tuple, tuple] = {}
        settled: list[tuple] = []
        for h, key, at, low, high, after, before in rows(batches):
            same = (low, high, after, before)
            other = held.get(same)
            if other is None:
                held[same] = (h, key, at)
                if len(held) >= CONTEXTS_HELD:
                    yield batch([(*place, *context) for context, place in held.items()])
                    held = {}
                continue
            if (key, at) < other[1:]:
                held[same], (h, key, at) = (h, key, at), other
            settled.append((h, key, at, low, high, None, None))
            if len(settled) >= CONTEXTS_HELD:
                yield batch(settled)
                settled = []
        if held:
            yield batch([(*place, *context) for context, place in held.items()])
        if settled:
            yield batch(settled)

    return dirty.mapInArrow(run, CONTEXT)


# --- 3. Deep-shallow sorting ----------------------------------------------------------


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of strings of one length, by inserting them into a blind trie.

    A node holds only the place at which its strings first differ. A string is led down by single
    bytes to any leaf below its path, is compared with that leaf once, and branches off where the two
    differ. Copies of a string share a leaf.
    """
    copies: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        copies.setdefault(s, []).append(i)
    distinct = list(copies)
    if len(distinct) <= 2:
        return [i for s in sorted(distinct) for i in copies[s]]
    numbers = [int.from_bytes(s) for s in distinct]
    width = len(distinct[0])
    root: tuple | int = 0
    for new in range(1, len(distinct)):
        s, node = distinct[new], root
        while not isinstance(node, int):
            branch = node[1].get(s[node[0]])
            node = next(iter(node[1].values())) if branch is None else branch
        differ = width - ((numbers[new] ^ numbers[node]).bit_length() + 7) // 8
        old = distinct[node][differ]
        above, node = None, root
        while not isinstance(node, int) and node[0] < differ:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == differ:
            node[1][s[differ]] = new
            continue
        fork = (differ, {s[differ]: new, old: node})
        if above is None:
            root = fork
        else:
            above[1][s[above[0]]] = fork
    order: list[int] = []
    stack: list[tuple | int] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            order += copies[distinct[node]]
        else:
            stack += [child for _, child in sorted(node[1].items(), reverse=True)]
    return order


def deep_shallow(groups: np.ndarray, rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of bytes within groups: the order, and each row's common prefix with the row before
    it in the order (-1 at the start of a group)."""
    n, width = rows.shape
    order = np.argsort(groups, kind="stable")
    open_ = np.concatenate(([False], groups[order][1:] == groups[order][:-1]))  # ties with the row before
    for depth in range(0, shallow, 8):
        # multikey quicksort's equal parts, all at once: order each by its next character
        tied = open_ | np.append(open_[1:], False)
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part = np.cumsum(~open_[where])
        word = np.ascontiguousarray(rows[order[where], depth : depth + 8]).view(">u8").ravel().astype(np.uint64)
        moved = np.lexsort((word, part))
        order[where] = order[where[moved]]
        word = word[moved]
        open_[where[1:]] &= word[1:] == word[:-1]
    heads = np.flatnonzero(~open_ & np.append(open_[1:], False))
    for head in heads.tolist():
        tail = head + 1
        while tail < n and open_[tail]:
            tail += 1
        mine = order[head:tail]
        deep = [row.tobytes() for row in rows[mine, shallow:]]
        order[head:tail] = mine[blind_trie_order(deep)]
    common = np.full(n, -1, np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[1:] = np.where(groups[order][1:] == groups[order][:-1], lcp, -1)
    return order, common


def repeats(h: np.ndarray, key: np.ndarray, at: np.ndarray, low, high, after, before) -> tuple[np.ndarray, ...]:
    """``(id, start, end)`` of the strings that occur earlier among these contexts, runs merged."""
    first = np.lexsort((at, key))
    h, key, at, low, high, after, before = (x[first] for x in (h, key, at, low, high, after, before))
    right, shared = deep_shallow(h, after, GRAM)
    _, classes = np.unique(h, return_inverse=True)
    left, common = deep_shallow(classes, before, 16)
    again = np.zeros((len(h), BEFORE + 2), bool)
    place_right, place_left = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    for o in range(BEFORE + 1):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        place_right[right] = np.cumsum(shared < LENGTH - o)
        place_left[left] = np.cumsum(common < o)
        both = place_right[rows] * (len(h) + 1) + place_left[rows]
        _, leader = np.unique(both, return_index=True)  # rows are in corpus order
        hit = np.ones(len(rows), bool)
        hit[leader] = False
        again[rows[hit], o] = True
    step = np.diff(np.concatenate((np.zeros((len(h), 1), np.int8), again.view(np.int8)), axis=1), axis=1)
    row, o_first = np.nonzero(step == 1)
    _, o_after = np.nonzero(step == -1)
    return key[row], at[row] - (o_after - 1), at[row] - o_first + LENGTH


RUN = "id bigint, start bigint, end bigint"
SPANS = "array<struct<start:bigint,end:bigint>>"


def _runs(key, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, start, end)], ["id", "start", "end"])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sorted_repeats(open_: DataFrame) -> DataFrame:
    """Repeated runs among contexts, dealt by hash, one deep-shallow sort per block of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (
            [*(b.column(i).to_numpy() for i in range(5)), _bytes(b.column(5), LENGTH), _bytes(b.column(6), BEFORE)]
            for b in batches
            if b.num_rows
        )
        for columns in by_hash(parts, ROWS_AT_ONCE):
            _, group, n = np.unique(columns[0], return_inverse=True, return_counts=True)
            shared = n[group] > 1
            if shared.any():
                yield _runs(*repeats(*(x[shared] for x in columns)))

    return open_.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, RUN)


# --- 4. Crowded classes ---------------------------------------------------------------


def crowded_repeats(rows: DataFrame) -> DataFrame:
    """Repeated strings among contexts, by the earliest place of every different string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, starts = [], [], []
            for row in batch.to_pylist():
                text = row["before"][::-1] + row["after"]
                for o in range(row["low"], row["high"] + 1):
                    keys.append(xxhash.xxh3_128_digest(text[BEFORE - o : BEFORE - o + LENGTH]))
                    ids.append(row["id"])
                    starts.append(row["at"] - o)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64())],
                ["string", "id", "start"],
            )

    strings = rows.mapInArrow(run, "string binary, id bigint, start bigint")
    least = strings.groupBy("string").agg(F.min(F.struct("id", "start")).alias("first"))
    later = strings.join(least, "string").where(F.struct("id", "start") != F.col("first"))
    return later.select("id", "start", (F.col("start") + LENGTH).alias("end"))


# --- All together ---------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """``(id, text, ...)``: documents without an id come after all others, in order of a hash."""
    none = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("bigint"), none))


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def first_texts(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` -> ``(text_key, first)``: the smallest id of every different text."""
    keys = docs.select("id", text_key().alias("text_key"))
    return keys.groupBy("text_key").agg(F.min("id").alias("first"))


def repeated_runs(docs: DataFrame, crowd: int = CLASS) -> tuple[DataFrame, DataFrame]:
    """``docs(id, text)``, all texts different -> texts that may hold repeats ``(id, text)``, and runs
    ``(id, start, end)`` of repeated bytes, which may overlap."""
    lists = repeated_anchors(docs)
    dirty = stored(docs.select("id", "text").join(lists, "id").dropDuplicates(["id"]), "dirty")
    found = stored(contexts(dirty), "contexts")
    settled = found.where("after is null").select(
        "id", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + LENGTH).alias("end")
    )
    open_ = found.where("after is not null")
    full = open_.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("hash")
    full = stored(full, "crowded")
    crowded = crowded_repeats(open_.join(full, "hash", "left_semi"))
    runs = sorted_repeats(open_.join(full, "hash", "left_anti"))
    return dirty.select("id", "text"), settled.union(runs).union(crowded)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, crowd: int = CLASS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, spans, kept)``, one row per input row.

    ``spans`` are the maximal removed runs ``(start, end)`` in bytes of the UTF-8 text, ``kept``
    the other bytes joined, null where nothing is removed (the text is kept as it is). Earlier is
    the smaller ``doc_id``, then the earlier start; matches do not cross documents and are judged
    on the input. Null and short texts lose nothing. Rows that repeat an id and text are one document,
    each gets its result; ids are otherwise taken to be unique. Rows without an id come last, in
    order of a hash of their text.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs.select("doc_id", "text"))
    firsts = stored(first_texts(rows), "firsts")
    different = rows.select("id", "text").join(firsts.select(F.col("first").alias("id")), "id", "left_semi")
    dirty, runs = repeated_runs(different, crowd)
    spans = runs.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for text, mine in zip(batch.column("text"), batch.column("runs")):
                data = (text.as_py() or "").encode("utf-8", "replace")
                gone = merged([(r["start"], r["end"]) for r in mine.as_py()])
                found.append([{"start": i, "end": j} for i, j in gone])
                edges = [0, *(x for pair in gone for x in pair), len(data)]
                kept.append(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found, pa.list_(span)), pa.array(kept, pa.binary())],
                ["id", "spans", "kept"],
            )

    cut = dirty.join(spans, "id").mapInArrow(
        run, f"id bigint, spans {SPANS}, kept binary"
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    whole = rows.select(
        "doc_id", "id", size.alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"),
        text_key().alias("text_key"),
    ).join(firsts, "text_key")
    copy = (F.col("id") != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.lit(b"")
    return whole.join(cut.withColumn("kept_sha256", F.sha2("kept", 256)), "id", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, all_of_it).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.when(copy, nothing).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(nothing, 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
