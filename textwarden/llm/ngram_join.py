"""N-gram Jaccard join by prefix filters under several global orders of the tokens.

A text's tokens are its different word shingles. Let all tokens be in any one order: two sets of a Jaccard
similarity share a token among the first few of both, their prefixes, as many as may differ and one.
This holds for every order, so candidates must share a prefix token under several of them:

1. Over all texts, two orders: tokens of rare slots first (a table of ``SLOTS`` counts, whatever the size of
   the corpus), then by one or the other hash. Only texts go on that share a token of the first with another one,
   at positions and sizes that leave the similarity possible, and with the same one a token of the second; all
   holders of a token that more than ``FEW`` hold do.
2. Among those: by the exact number of texts that hold the token, then by hash. These prefix tokens are the
   join keys; their positions bound how much two texts can share, which ends most comparisons.
3. The same numbers, then another hash.

A pair found under this order must also share a token under the third; what is left
is verified on whole sets. Equal sets are one node. Groups of near-copies would make pairs that grow with
the square of the group: members of a key are first compared with two leaders each, verified links are
contracted, and only pairs of a key that are still in different components follow, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import bounded_batches, components, discard, stored

WORDS, PERCENT = 3, 90
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
FEW = 64
"""Up to so many holders of a token are compared pair by pair to see who goes on."""

BROADCAST_KEYS = 1_000_000
"""Up to so many keys of texts (8 MB) are sent to all tasks; more are joined by a shuffle."""

LEADER_ROUNDS = 2
BYTES_AT_ONCE = 1 << 20
SETS_KNOWN = 1_000_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * M1
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(29))


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
ODD = 0xD1342543DE82EF95


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, factor, np.uint64))), dtype=np.uint64)
                for factor in (ODD, pow(ODD, -1, 1 << 64))
            )
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word between ASCII blanks: a polynomial of its bytes, mixed with its length.

    The polynomials of all words are differences of one running sum, shifted to the words' beginnings.
    """
    out, at = [], 0
    while at < len(data):
        to = len(data)
        if to - at > BYTES_AT_ONCE:  # cut long texts behind a blank
            cut = np.flatnonzero(BLANK[np.frombuffer(data, np.uint8, offset=at + BYTES_AT_ONCE)][: 1 << 16])
            to = at + BYTES_AT_ONCE + int(cut[0]) + 1 if len(cut) else to
        part = np.frombuffer(data, np.uint8, to - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[part], [True])).view(np.int8)))
        first, end = edges[0::2], edges[1::2]
        up, down = POWERS.to(len(part))
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[part] * up, dtype=np.uint64)))
        sums = (running[end] - running[first]) * down[first]
        out.append(_mix(sums, 0x9E37) + _mix((end - first).astype(np.uint64)))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's different shingles, sorted; a text of fewer words has one, all of it."""
    hashes = word_hashes((text or "").encode("utf-8", "replace").translate(LOWER))
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    last = len(hashes) - width + 1
    mixed = np.full(last, width, np.uint64)
    for i in range(width):
        mixed = _mix(mixed + hashes[i : i + last])
    return np.unique(mixed)


def signature(tokens: np.ndarray) -> int:
    """One signed number for a set."""
    total = _mix(tokens, 0x5BF0).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(_mix(np.array([total]))[0].view(np.int64))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def row_key() -> Column:
    return F.xxhash64("text", "doc_id")


def slot_classes(docs: DataFrame, words: int) -> np.ndarray:
    """How far every slot's number of the texts' tokens exceeds the median: the quarter powers of two of its excess
    in standard deviations of chance, from two on. Frequent tokens show long before they double a slot.

    The table has ``SLOTS`` rows, the only thing that goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                slots = (shingle_set(text.as_py(), words) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                np.add.at(counts, slots, 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["slot", "n"])

    found = docs.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    table = np.zeros(SLOTS)
    counts = found.toArrow()
    table[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    usual = max(np.median(table), 1)
    excess = (table - usual) / np.sqrt(usual)
    return np.clip(1 + 4 * np.log2(np.maximum(excess, 1) / 2), 0, 255).astype(np.uint8)


def first_prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, row_key, size, node, keys, again)``: the number of different shingles,
    the set's signature, its prefix under the first order, in order, and 32 bits of every token of its prefix
    under the same order with another hash. Rows whose set the task has just given out have no prefixes."""
    classes = slot_classes(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            sizes, nodes, keys, again = [], [], [], []
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), words)
                few = prefix_length(len(tokens), percent) if len(tokens) else 0
                node = signature(tokens) if few else None
                sizes.append(len(tokens))
                nodes.append(node)
                if node is None or node in given:
                    keys.append(None)
                    again.append(None)
                    continue
                if len(given) >= SETS_KNOWN:
                    given.clear()
                given.add(node)
                rare = classes[tokens >> np.uint64(64 - SLOT_BITS)].astype(np.uint64) << np.uint64(56)
                order, other = (np.argsort(rare | (_mix(tokens, salt) >> np.uint64(8)))[:few] for salt in (1, 2))
                keys.append(tokens[order].view(np.int64))
                again.append(tokens[other].astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int32()),
                    pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(again, pa.list_(pa.int32())),
                ],
                ["doc_id", "row_key", "size", "node", "keys", "again"],
            )

    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(
        run, "doc_id bigint, row_key bigint, size int, node bigint, keys array<bigint>, again array<int>"
    )


def holders() -> Column:
    """How many rows have a row's token. The window shuffles and sorts narrow rows once, where a join with the
    counts would shuffle them twice; a frequent token's rows spill to disk."""
    return F.count("*").over(Window.partitionBy("token"))


def partners(rows: DataFrame, percent: int) -> DataFrame:
    """``rows(node, size, keys, again)`` -> the ``node`` of all sets that may be similar to another one.

    Copies of a set bring their prefixes at most once per task, and are dropped where the tokens meet."""
    nodes = rows.where("keys is not null")
    entries = nodes.select("node", "size", F.posexplode("keys").alias("pos", "token")).repartition("token").distinct()
    shared = stored(entries.withColumn("n", holders()).where("n > 1"), "shared")
    # few holders: a list of at most FEW, of which all pairs are looked at
    lists = shared.where(F.col("n") <= FEW).groupBy("token").agg(
        F.array_sort(F.collect_list(F.struct("node", "size", "pos"))).alias("held")
    )
    one = lists.select("held", F.inline("held")).withColumnsRenamed({"node": "a", "size": "sa", "pos": "pa"})
    pairs = (
        one.select("a", "sa", "pa", F.inline(F.filter("held", lambda x: x["node"] > F.col("a"))))
        .withColumnsRenamed({"node": "b", "size": "sb", "pos": "pb"})
        .where(possible(percent))
        .select("a", "b")
        .distinct()
    )
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("again").alias("again" + side)), side)
    close = pairs.where(F.arrays_overlap("againa", "againb"))
    crowded = shared.where(F.col("n") > FEW).select("node")
    found = stored(close.select(F.explode(F.array("a", "b")).alias("node")).union(crowded).distinct(), "partners")
    discard(shared)
    return found


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted(row_key, times)`` -> ``(node, size, tokens)`` of these rows, one row for each set.

    Only sets whose row stands there several times are put together by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), words) for text in batch.column("text")]
            columns = [
                pa.array([signature(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                batch.column("times"),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "tokens", "times"])

    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = docs.select("text", row_key().alias("row_key")).join(wanted, "row_key").select("text", "times")
    sets = stored(texts.mapInArrow(run, "node bigint, size int, tokens array<bigint>, times bigint"), "sets")
    one = sets.where("times = 1").drop("times")
    several = sets.where("times > 1").groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    return one.union(several)


def exact_orders(sets: DataFrame, percent: int) -> DataFrame:
    """``sets(node, size, tokens)`` -> ``(node, size, alone, second, third)``: the number of tokens that no other
    set holds (the first of both orders, and no keys), and the prefixes under the second and third order."""
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    shared = tokens.withColumn("n", holders().cast("int")).where("n > 1")
    held = shared.groupBy("node").agg(F.collect_list(F.struct("n", "token")).alias("shared"))
    held = held.join(sets.select("node", "size"), "node")
    alone = F.col("size") - F.size("shared")
    few = F.col("size") - F.ceil(F.col("size") * percent / 100.0 - 1e-9).cast("int") + 1 - F.col("alone")
    again = F.transform("shared", lambda x: F.struct(x["n"], F.xxhash64(x["token"]).alias("h"), x["token"]))
    return (
        held.withColumn("alone", alone)
        .withColumn("few", few)
        .where("few > 0")
        .select(
            "node", "size", "alone",
            F.slice(F.array_sort("shared"), F.lit(1), F.col("few"))["token"].alias("second"),
            F.slice(F.array_sort(again), F.lit(1), F.col("few"))["token"].alias("third"),
        )
    )


def least_shared(percent: int) -> Column:
    """Tokens that sets of ``sa`` and ``sb`` must share."""
    return F.expr(f"((sa + sb) * {percent} + {99 + percent}) div {100 + percent}")


def possible(percent: int) -> Column:
    """Whether sets whose first common token stands at ``pa`` and ``pb`` can be similar."""
    return F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= least_shared(percent)


def verified(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that share a token of the third prefixes and are similar."""

    def both(of: DataFrame, table: DataFrame, *names: str) -> DataFrame:
        for side in ("a", "b"):
            of = of.join(table.select(F.col("node").alias(side), *[F.col(n).alias(n + side) for n in names]), side)
        return of

    filters = both(pairs, prefixes, "third")
    left = stored(filters.where(F.arrays_overlap("thirda", "thirdb")).select("a", "b"), "pairs")
    ids = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = stored(sets.join(ids, "node", "left_semi").select("node", "size", "tokens"), "needed")
    common = F.size(F.array_intersect("tokensa", "tokensb"))
    total = F.col("sizea") + F.col("sizeb") - common
    found = both(left, needed, "size", "tokens").where(100 * common >= percent * total).select("a", "b")
    found = stored(found, "links")
    discard(needed)
    return found


def crossing(entries: DataFrame, links: DataFrame | None) -> DataFrame:
    """``entries(token, node, ...)`` of the tokens whose nodes are in several components, with each node's
    component ``root`` and the token's most frequent one, ``major``."""
    if links is None:
        now = entries.withColumn("root", F.col("node"))
    else:
        roots = components(links)
        now = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = stored(now, "members")
    open_ = (
        now.groupBy("token", "root")
        .agg(F.count("*").alias("n"))
        .groupBy("token")
        .agg(F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("major"))
        .where("parts > 1")
        .drop("parts")
    )
    return stored(now.join(open_, "token"), "open")


def _side(members: DataFrame, side: str) -> DataFrame:
    return members.select(
        "token", "major", F.col("node").alias(side), F.col("root").alias("r" + side), F.col("size").alias("s" + side),
        F.col("pos").alias("p" + side),
    )


def similar_links(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """``prefixes(node, size, alone, second, third)`` -> links ``(a, b)`` whose components are those of all
    similar pairs; nothing if there is none."""
    entries = stored(
        prefixes.select("node", "size", "alone", F.posexplode("second").alias("at", "token")).select(
            "token", "node", "size", (F.col("alone") + F.col("at")).alias("pos")
        ),
        "entries",
    )
    links: DataFrame | None = None

    def with_links(found: DataFrame) -> DataFrame | None:
        if links is not None:
            return links.union(found)
        return None if found.isEmpty() else found

    for turn in range(LEADER_ROUNDS):
        members = crossing(entries, links)
        chance = F.xxhash64("node", F.lit(turn))
        leader = F.struct(*[F.col(c).alias(n) for c, n in (("node", "b"), ("root", "rb"), ("size", "sb"), ("pos", "pb"))])
        # the member with the fewest tokens before the key is like most others; another by chance
        led = members.groupBy("token").agg(
            F.array_distinct(F.array(F.min_by(leader, F.struct("pos", chance)), F.min_by(leader, chance))).alias("leaders")
        )
        tried = (
            members.join(led, "token")
            .select(
                F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("pos").alias("pa"),
                F.inline("leaders"),
            )
            .where(F.col("ra") != F.col("rb"))
            .where(possible(percent))
            .groupBy("a", "b")
            .agg(F.count("*").alias("n"))
        )
        best = Window.partitionBy("a").orderBy(F.col("n").desc(), "b")
        tried = tried.withColumn("n", F.row_number().over(best)).where("n <= 2").select("a", "b")
        links = with_links(verified(stored(tried, "tried"), prefixes, sets, percent))
    members = crossing(entries, links)
    minor = _side(members, "a").where(F.col("ra") != F.col("major"))
    # a pair of two minor members is met from both sides
    rest = (
        minor.join(_side(members, "b").drop("major"), "token")
        .where(F.col("ra") != F.col("rb"))
        .where((F.col("rb") == F.col("major")) | (F.col("a") < F.col("b")))
        .where(possible(percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    return with_links(verified(stored(rest, "rest"), prefixes, sets, percent))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id)``, one row per input row.

    Texts are lower-cased (A-Z) and cut at ASCII blanks; a set holds the different shingles of ``words`` words, or
    the whole sequence where a text has fewer. Sets link when ``100 * shared >= percent * union``.
    ``component_id`` is the smallest ``doc_id`` reachable by links, the row's own included. Null, empty and
    blank texts have no shingle and no link. Repeated rows, and rows without an id, are texts like
    others; a null id never names a component unless it has no other. Shingles are told apart by 64-bit hashes.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and up to 100")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    full = stored(first_prefixes(docs, words, percent), "prefixes")
    rows = stored(full.select("doc_id", "row_key", "size", "node"), "rows")
    chosen = rows.where("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"))
    chosen = chosen.join(partners(full, percent), "node", "left_semi")
    discard(full)
    times = rows.groupBy("row_key").agg(F.count("*").alias("times"))
    wanted = stored(chosen.join(times, "row_key").select("row_key", "times"), "wanted")
    sets = whole_sets(docs, wanted, words)
    prefixes = stored(exact_orders(sets, percent), "orders")
    links = similar_links(prefixes, sets, percent)
    first = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    if links is not None:
        first = first.join(components(links), "node", "left")
        first = first.withColumn("root", F.coalesce("root", "node"))
    else:
        first = first.withColumn("root", F.col("node"))
    named = stored(first, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = named.where("node is not null").join(least, "root").select("node", "component_id")
    out = rows.where("node is not null").join(found, "node").select("doc_id", "size", "component_id")
    alone = rows.where("node is null").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return out.union(alone).select("doc_id", F.col("size").cast("bigint").alias("n_shingles"), "component_id")
