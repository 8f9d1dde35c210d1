"""Conversation structure repair by integer shortest paths.

A conversation is repaired when its turns' roles are, in order, an optional system turn followed by
pairs of user and assistant, or when no turn is left. Every row is kept, given another role or deleted;
turns without text may be inserted. The cheapest repair is a shortest path through layers of four states,
one layer per row. A path's weight is one integer: its high digits are the cost, its low ones the letters
of its edits at fixed width, the first letter in the highest place and zeros at the end. The smallest
integer is therefore the cheapest repair and, of several, the one whose letters come first in ASCII order;
nothing else decides.

Two paths to one state never have equal cost with the letters of one beginning those of the other (the rest
could only be insertions, which cost), so weights of paths compose: a long conversation is cut into
blocks, whose shortest paths between all pairs of states are found apart, wherever the sort puts them, and
joined in order. Behind a block the letters so far are replaced by their rank among the four states, so
integers stay as wide as a block. Texts travel once, to be hashed in order, and no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import bounded_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
"""Costs: of the four edits, and of a truncated row that stays."""

BLOCK = 128
"""Rows whose paths are found together."""

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
"""By the initial of a row's role: the states in which it may stay, and where it leads."""
GIVEN = KEPT["u"] | KEPT["a"]
"""The same for rows that get the role which fits, and for inserted ones."""
LETTERS = "\0DIKR"
BITS = 3
DIGITS = str.maketrans({letter: str(i) for i, letter in enumerate(LETTERS)})
ROLES = {USER: "user", ASSISTANT: "assistant"}

Node = tuple[int, int]
"""A path's weight and its number of letters."""


def _edge(node: Node, letter: str, cost: int, width: int) -> Node:
    value, n = node
    return value + (cost << BITS * width) + (LETTERS.index(letter) << BITS * (width - 1 - n)), n + 1


def _inserted(best: dict[int, Node], width: int) -> dict[int, Node]:
    """The states after up to two insertions; a third would close a circle."""
    new, out = best, dict(best)
    for _ in range(2):
        found: dict[int, Node] = {}
        for q, node in new.items():
            if q in GIVEN:
                more = _edge(node, "I", INSERT, width)
                found[GIVEN[q]] = min(found.get(GIVEN[q], more), more)
        new = found
        for q, node in new.items():
            out[q] = min(out.get(q, node), node)
    return out


def _step(best: dict[int, Node], row: tuple[str, bool, bool], width: int) -> dict[int, Node]:
    initial, lost, truncated = row
    extra = TRUNCATED if truncated else 0
    out: dict[int, Node] = {}
    for q, node in _inserted(best, width).items():
        moves = [(q, "D", DELETE)]
        if not lost:
            if q in KEPT.get(initial, {}):
                moves.append((KEPT[initial][q], "K", KEEP + extra))
            if q in GIVEN:
                moves.append((GIVEN[q], "R", REROLE + extra))
        for to, letter, cost in moves:
            found = _edge(node, letter, cost, width)
            out[to] = min(out.get(to, found), found)
    return out


def _read(node: Node, width: int) -> tuple[int, str]:
    """Cost and letters of a weight."""
    value, n = node
    digit = lambda i: LETTERS[(value >> BITS * (width - 1 - i)) & 7]
    return value >> BITS * width, "".join(map(digit, range(n)))


def paths(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...] = STATES) -> list[tuple[int, int, int, str]]:
    """Shortest paths over ``rows(initial, must go, truncated)``: ``(from, to, cost, letters)``.

    All end with the last row; what is inserted behind it belongs to the rows that follow.
    """
    width, out = 3 * len(rows), []
    for start in starts:
        best: dict[int, Node] = {start: (0, 0)}
        for row in rows:
            best = _step(best, row, width)
        out += [(start, q, *_read(node, width)) for q, node in sorted(best.items())]
    return out


def weight(cost: int, rank: int, letters: str, width: int) -> int:
    """A path's weight, with the rank of the letters before it in front of its own."""
    digits = letters.translate(DIGITS).ljust(width, "0")
    return (((cost << 2) + rank) << BITS * width) + int(digits, 8)


def last_inserts(state: int) -> tuple[int, str] | None:
    """Cost and letters of what must be inserted behind the last row."""
    found = _inserted({state: (0, 0)}, 2)
    ends = [found[q] for q in (START, ASSISTANT) if q in found]
    return _read(min(ends), 2) if ends else None


def damage(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> the damaged rows with ``n``, how often each stands there.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties the text, 2 takes its ``[.!?]`` out,
    3 repeats the row, 4 makes it a user's. Nulls count as one space.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    chance = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), blank) for c in ("text", "role"))
    return turns.where(chance != 0).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(chance == 4, "user").otherwise(role).alias("role"),
        F.when(chance == 1, "").when(chance == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(chance == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


ORDER = ("conv_id", "turn", "role", "h1", "h2")
"""Order of a conversation's rows: by turn, nulls first; ties by role, then by two hashes of the text."""


def judged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, n)`` -> its different rows without their texts, with their faults.

    ``first`` is false where an earlier turn has the same role and text. Of ``n`` equal rows of one turn all but
    the first repeat it.
    """
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    narrow = (
        rows.select(
            *ORDER[:3], F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "n",
            (solid == "").alias("blank"), (~solid.rlike(r"[.!?]\z")).alias("truncated"),
        )
        .groupBy(*ORDER, "blank", "truncated")
        .agg(F.sum("n").alias("n"))
    )
    narrow = stored(narrow, "turns")
    same = ["conv_id", "role", "h1", "h2"]
    least = F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("_least")
    earliest = narrow.groupBy(*[F.col(name).alias("_" + name) for name in same]).agg(least)
    on = [F.col(name).eqNullSafe(F.col("_" + name)) for name in same]
    first = F.col("_least.turn").eqNullSafe(F.col("turn")).alias("first")
    return narrow.join(earliest, on).select(*ORDER, "blank", "truncated", "n", first)


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated)`` of the rows of :func:`judged`."""
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("int")).otherwise(0)).alias("duplicate"),
        F.count_if(~F.col("blank") & F.col("first") & F.col("truncated")).alias("truncated"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )


SOURCE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("h1", pa.int64()), ("h2", pa.int32())])
PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])
BLOCKS = (
    "conv_id bigint, part int, seq bigint, head string, tail string, illegal bigint,"
    " sources array<struct<turn: bigint, role: string, h1: bigint, h2: int>>,"
    " paths array<struct<start: int, end: int, cost: bigint, letters: string>>"
)
BLOCK_TYPES = {
    "conv_id": pa.int64(), "part": pa.int32(), "seq": pa.int64(), "head": pa.string(), "tail": pa.string(),
    "illegal": pa.int64(), "sources": pa.list_(SOURCE), "paths": pa.list_(PATH),
}
LEGAL = ("su", "ua", "au")


def _batch(rows: list[dict], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of :func:`judged`, sorted over all tasks, cut into blocks with their shortest paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        conv, opened, steps, sources = None, False, [], []
        whole = False  # whether the conversation's first row lies in this task

        def block() -> dict:
            initials = [step[0] for step in steps]
            bad = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            found = paths(steps, (START,) if whole else STATES)
            return {
                "conv_id": conv, "part": part, "seq": seq, "head": initials[0], "tail": initials[-1], "illegal": bad,
                "sources": sources, "paths": [dict(zip(("start", "end", "cost", "letters"), p)) for p in found],
            }

        for batch in batches:
            for row in batch.to_pylist():
                if not opened or row["conv_id"] != conv:
                    if steps:
                        out.append(block())
                    whole, seq = opened, seq + 1
                    conv, opened, steps, sources = row["conv_id"], True, [], []
                for i in range(row["n"]):
                    if len(steps) == size:
                        out.append(block())
                        whole, seq, steps, sources = False, seq + 1, [], []
                    lost = row["blank"] or not row["first"] or i > 0
                    steps.append((row["role"][:1], lost, row["truncated"]))
                    sources.append(None if lost else {name: row[name] for name in ORDER[1:]})
                    if len(out) >= 1000:
                        yield _batch(out, BLOCK_TYPES)
                        out = []
        if steps:
            out.append(block())
        if out:
            yield _batch(out, BLOCK_TYPES)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER)
    return dealt.select(*ORDER, "blank", "truncated", "n", "first").mapInArrow(run, BLOCKS)


JOINED = (
    "conv_id bigint, last boolean, turn bigint, role string, h1 bigint, h2 int, lead string, as_role string,"
    " illegal bigint, cost bigint, audit string"
)
JOINED_TYPES = {
    "conv_id": pa.int64(), "last": pa.bool_(), "turn": pa.int64(), "role": pa.string(), "h1": pa.int64(), "h2": pa.int32(),
    "lead": pa.string(), "as_role": pa.string(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(),
}


class _Conversation:
    """Joins the blocks of one conversation in order, and gives out decisions as soon as all states
    agree on them."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.illegal, self.tail = conv_id, 0, None
        self.best = {START: (0, 0)}  # state -> cost and rank of its letters
        self.open: list[tuple[dict, dict]] = []  # blocks without a decision, and the paths that lead to their ends
        self.state, self.lead, self.audit = START, "", []

    def row(self, **values: object) -> dict:
        return {name: values.get(name) for name in JOINED_TYPES} | {"conv_id": self.conv_id}

    def add(self, block: dict) -> Iterator[dict]:
        self.illegal += block["illegal"] + (self.tail is not None and self.tail + block["head"] not in LEGAL)
        self.tail = block["tail"]
        width = max(len(path["letters"]) for path in block["paths"])
        found: dict[int, tuple] = {}
        for path in block["paths"]:
            if path["start"] not in self.best:
                continue
            cost, rank = self.best[path["start"]]
            value = weight(cost + path["cost"], rank, path["letters"], width)
            if path["end"] not in found or value < found[path["end"]][0]:
                found[path["end"]] = value, path["start"], path["letters"]
        bits = BITS * width
        order = sorted(found, key=lambda q: found[q][0] & ((1 << bits + 2) - 1))
        self.best = {q: (found[q][0] >> bits + 2, rank) for rank, q in enumerate(order)}
        self.open.append((block, {q: found[q][1:] for q in found}))
        agreed, states = 0, set(self.best)
        for i in range(len(self.open) - 1, -1, -1):
            states = {self.open[i][1][q][0] for q in states}
            if len(states) == 1:
                agreed = i
                break
        if agreed:
            yield from self.settle(agreed, states.pop())

    def settle(self, upto: int, state: int) -> Iterator[dict]:
        """Give out the decisions of the first ``upto`` open blocks, the last of which ends in ``state``."""
        chosen = []
        for block, ends in reversed(self.open[:upto]):
            state, letters = ends[state]
            chosen.append((block, letters))
        self.open = self.open[upto:]
        for block, letters in reversed(chosen):
            yield from self.decide(block["sources"], letters)

    def decide(self, sources: list[dict | None], letters: str) -> Iterator[dict]:
        self.audit.append(letters)
        at = 0
        for letter in letters:
            if letter == "I":
                self.state = GIVEN[self.state]
                self.lead += "ua"[self.state == ASSISTANT]
                continue
            source = sources[at]
            at += 1
            if letter == "D":
                continue
            if letter == "K":
                role, self.state = source["role"], KEPT[source["role"][0]][self.state]
            else:
                self.state = GIVEN[self.state]
                role = ROLES[self.state]
            yield self.row(last=False, lead=self.lead, as_role=role, **source)
            self.lead = ""

    def end(self) -> Iterator[dict]:
        ends = []
        for q, (cost, rank) in self.best.items():
            tail = last_inserts(q)
            if tail is not None:
                ends.append((weight(cost + tail[0], rank, tail[1], 2), q, tail[1]))
        value, state, letters = min(ends)
        cost = value >> 2 * BITS + 2
        yield from self.settle(len(self.open), state)
        yield from self.decide([], letters)
        yield self.row(
            last=True, lead=self.lead, illegal=self.illegal, cost=cost, audit="".join(self.audit)
        )


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for batch in batches:
        for block in batch.to_pylist():
            if now is None or now.conv_id != block["conv_id"]:
                if now is not None:
                    out += now.end()
                now = _Conversation(block["conv_id"])
            for row in now.add(block):
                out.append(row)
            if len(out) >= 10_000:
                yield _batch(out, JOINED_TYPES)
                out = []
    if now is not None:
        out += now.end()
    if out:
        yield _batch(out, JOINED_TYPES)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, every decision followed by its text -> the hash of each repaired conversation."""
    types = {"conv_id": pa.int64(), "repaired_sha256": pa.string()}
    opened, conv, digest, empty, wanted, out = False, None, hashlib.sha256(), True, None, []

    def line(head: str, text: str) -> None:
        nonlocal empty
        digest.update(("" if empty else "\n").encode() + f"{head}:{text}".encode("utf-8", "replace"))
        empty = False

    for batch in batches:
        for row in batch.to_pylist():
            if not opened or row["conv_id"] != conv:
                if opened:
                    out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                opened, conv, digest, empty, wanted = True, row["conv_id"], hashlib.sha256(), True, None
            key = tuple(row[c] for c in ORDER[1:])
            if row["text"] is None:
                for role in row["lead"] or "":
                    line("user" if role == "u" else "assistant", "")
                wanted = None if row["last"] else (key, row["as_role"])
            elif wanted is not None and wanted[0] == key:
                line(wanted[1], row["text"])
                wanted = None
        if out:
            yield _batch(out, types)
            out = []
    if opened:
        yield _batch([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], types)


def decisions(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of :func:`judged` -> a row for every turn that stays (``lead``: initials of the turns inserted before
    it, ``as_role``: its role) and, with ``last``, one per conversation: ``illegal, cost, audit``."""
    found = stored(blocks(rows, block), "blocks")
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_join, JOINED)


EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame, original: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``turns(conv_id, turn, role, text, n)`` -> a row per conversation: ``conv_id``, the counts of faults ``gaps,
    blank, duplicate, truncated, illegal``, and the repair: ``cost, audit, repaired_sha256``.

    A row's faults: no text but ASCII blanks; role and text that an earlier row has; a text that does not end
    with ``[.!?]``. Only the first counts. Null roles and texts count as one space. Blank and repeated rows must go. ``illegal`` counts neighbours whose
    roles' initials are not ``su``, ``ua`` or ``au``. Rows are taken by turn, null turns first, ties by role and then by a
    hash of the text. The conversations of ``original`` of which no row is left have zeros, an empty audit
    and the hash of the empty string. A null ``conv_id`` is a conversation of its own, an empty role has no initial and
    cannot stay, a table without rows gives none. Columns besides these are not read.
    """
    bounded_batches(turns.sparkSession)
    given = [F.coalesce(name, F.lit(" ")).alias(name) for name in ("role", "text")]
    turns = stored(turns.select("conv_id", "turn", *given, "n"), "damaged")
    rows = stored(judged(turns), "judged")
    made = stored(decisions(rows, block), "decisions")
    ends = made.where("last").select("conv_id", "illegal", "cost", "audit")
    texts = turns.select(
        "conv_id", F.lit(False).alias("last"), "turn", "role",
        F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "text",
    )
    wanted = made.select("conv_id", "last", *ORDER[1:], "lead", "as_role")
    both = wanted.unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "last", *ORDER[1:], F.col("text").isNotNull())
    hashes = dealt.mapInArrow(_hash, "conv_id bigint, repaired_sha256 string")
    ids = (turns if original is None else original).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()

    def attach(df: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnRenamed("conv_id", "_other")
        return df.join(other, F.col("conv_id").eqNullSafe(F.col("_other")), "left").drop("_other")

    found = attach(attach(attach(ids, faults(rows)), ends), hashes)
    zero: Column = F.lit(0).cast("bigint")
    return found.select(
        "conv_id",
        *[F.coalesce(name, zero).alias(name) for name in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"),
    )
