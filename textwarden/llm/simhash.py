"""SimHash near-duplicates, found through deletion-variant signatures.

Two 64-bit fingerprints at a distance of four bits or less, cut into three segments, have one
segment in which they differ by one bit at most. Every fingerprint is therefore indexed under its
three segments with each bit in turn wiped out (a wildcard): 64 keys. Fingerprints that link share
a key, so an equality join finds all of them, and the join condition verifies the distance.

The rows of all keys are sorted once by key and fingerprint, in one shuffle. Most keys hold two or three fingerprints;
all their pairs are those of a row with the two before it. Groups of near-copies make fuller keys, and all
pairs of those would grow with the square of the group. Three steps avoid that without losing a link between components:

1. Fingerprints with a whole segment in common, three keys each, are compared with up to four leaders of the
   key, picked by a hash, and give a link to the first that is close. Verified links are contracted to components,
   which join most near-copies. Only wildcard keys that hold several components are looked at from here on.
2. Every fingerprint of such a key is compared with the two before it, and in full keys with the key's leaders, in
   other components. The links are contracted as links between the components so far.
3. Full keys all of whose fingerprints are in one component now are done. The fingerprints of the others, once each,
   go under finer keys: close fingerprints agree in two of ``max_bits + 2`` segments, and in three of ``max_bits + 3``.
   Members outside a key's most frequent component are joined with close members of other components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import bounded_batches, components, stored

SEED = 42
SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
"""First bit and length of the segments. One of three segments differs by one bit at most for any two
fingerprints at a distance of up to five bits."""

MOST_BITS = 2 * len(SEGMENTS) - 1
FEW_NODES = 1 << 17
"""Up to so many fingerprints share two segments, some 20 bits, only with a few strangers."""

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS_AT_ONCE = 1 << 16
TEXT_BYTES = 2 << 20
"""A batch of texts comes back as longer lists of hashes, which lie in both processes several times."""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: A-Z only, cut at ASCII blanks."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text: a bit is 1 if set in over half the shingle hashes.

    Null, empty and blank texts have no shingle and the fingerprint 0; a text of fewer words than
    ``width`` has one shingle, all of it.
    """
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at : at + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp, text_key)``: the fingerprint as a signed long, and a
    hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            columns = [batch.column("doc_id"), fp, batch.column("text_key")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_key"])

    bounded_batches(docs.sparkSession, TEXT_BYTES)
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        run, "doc_id bigint, fp bigint, text_key bigint"
    )


def index(nodes: DataFrame) -> DataFrame:
    """``nodes(fp, ...)`` -> one row per wildcard: ``(key, fp, ...)``.

    The key holds the wildcard's position and its segment with that bit cleared.
    """
    keys = []
    for first, length in SEGMENTS:
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << length) - 1))
        for bit in range(length):
            kept = part.bitwiseAND(F.lit(((1 << length) - 1) & ~(1 << bit)))
            keys.append(kept.bitwiseOR(F.lit((first + bit) << 22)))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "*")


def whole_segments(nodes: DataFrame) -> DataFrame:
    """``nodes(fp)`` -> ``(key, fp, root)`` under each of the whole segments, every fingerprint a component."""
    keys = []
    for first, length in SEGMENTS:
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << length) - 1))
        keys.append(part.bitwiseOR(F.lit(first << 22)))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp", F.col("fp").alias("root"))


def close(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``nodes(fp)``, all different -> links ``(a, b)`` whose components are those of all pairs
    at ``max_bits`` bits or fewer."""
    return linked(nodes, max_bits)[0]


def linked(nodes: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """``nodes(fp)``, all different -> the links of :func:`links`, and every node's component: ``(fp, root)``."""
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"the segments find distances up to {MOST_BITS}")
    nodes = nodes.select("fp")
    stars = stored(led_links(whole_segments(nodes), max_bits).distinct(), "stars").select("a", "b")
    roots = stored(rooted(nodes, stars, "fp", "root"), "rooted")

    met = stored(neighbours(index(roots), max_bits), "met")
    full = met.where("n > 3").select("key", "fp", "root")
    near = met.select(F.col("fp").alias("a"), F.col("root").alias("ra"), F.inline("near")).select("a", "b", "ra", "rb")
    first = stored(near.union(led_links(full, max_bits)).distinct(), "first")
    roots = contracted(roots, first)

    now = full.select("key", "fp").join(roots, "fp")
    apart = stored(mixed_members(now).select("fp", "root").distinct(), "apart")
    finer = stored(mixed_members(finer_keys(apart, max_bits)), "finer")
    minor = finer.where("root <> major").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"), "major")
    other = finer.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    # a pair of two minor members is met from both sides
    rest = (
        minor.join(other, "key")
        .where(F.col("ra") != F.col("rb"))
        .where((F.col("rb") == F.col("major")) | (F.col("a") < F.col("b")))
        .where(close("a", "b", max_bits))
        .select("a", "b", "ra", "rb")
        .distinct()
    )
    rest = stored(rest, "rest")
    return stars.union(first.select("a", "b")).union(rest.select("a", "b")), contracted(roots, rest)


def neighbours(entries: DataFrame, max_bits: int) -> DataFrame:
    """``entries(key, fp, root)`` -> ``(key, fp, root, n, near)`` of the keys that hold several components: the number
    of the key's members, and which of the two before the row are close and in another component."""
    by_key = Window.partitionBy("key").orderBy("fp")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = [
        F.struct(F.lag("fp", i).over(by_key).alias("b"), F.lag("root", i).over(by_key).alias("rb")) for i in (1, 2)
    ]
    other = lambda x: (x["rb"] != F.col("root")) & (F.bit_count(x["b"].bitwiseXOR(F.col("fp"))) <= max_bits)
    return (
        entries.select(
            "key", "fp", "root", F.array(*before).alias("before"), F.count("*").over(whole).alias("n"),
            F.min("root").over(whole).alias("lo"), F.max("root").over(whole).alias("hi"),
        )
        .where("lo <> hi")
        .select("key", "fp", "root", "n", F.filter("before", other).alias("near"))
    )


def contracted(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots(fp, root)`` after the links ``found(ra, rb, ...)`` between components."""
    if found.isEmpty():
        return roots
    joined = rooted(roots, found.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "root", "joined")
    return stored(joined.select("fp", F.col("joined").alias("root")), "rooted")


def led_links(full: DataFrame, max_bits: int) -> DataFrame:
    """``full(key, fp, root)`` -> links ``(a, b, ra, rb)`` of every member to the first of its key's leaders that is
    close and in another component, with both components."""
    chance = F.xxhash64("fp", "key")
    member = F.struct("fp", "root")
    led = full.groupBy("key").agg(
        F.array(F.min_by(member, chance), F.max_by(member, chance), F.min(member), F.max(member)).alias("leaders"),
        F.min("root").alias("first"),
        F.max("root").alias("last"),
    )
    led = led.where("first <> last").select("key", "leaders")
    other = lambda x: (x["root"] != F.col("root")) & (F.bit_count(x["fp"].bitwiseXOR(F.col("fp"))) <= max_bits)
    found = full.join(led, "key").select("fp", "root", F.get(F.filter("leaders", other), 0).alias("leader"))
    return found.where("leader is not null").select(
        F.col("fp").alias("a"), F.col("leader.fp").alias("b"), F.col("root").alias("ra"), F.col("leader.root").alias("rb")
    )


def mixed_members(members: DataFrame) -> DataFrame:
    """``members(key, fp, root)`` of the keys whose members are in several components, with the key's most frequent
    one, ``major``."""
    of_root = F.count("*").over(Window.partitionBy("key", "root"))
    by_key = Window.partitionBy("key")
    return (
        members.repartition("key")
        .withColumn("n", of_root)
        .select(
            "key", "fp", "root", F.max(F.struct("n", "root")).over(by_key)["root"].alias("major"),
            F.min("root").over(by_key).alias("lo"), F.max("root").over(by_key).alias("hi"),
        )
        .where("lo <> hi")
        .drop("lo", "hi")
    )


def finer_keys(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes(fp, ...)`` -> ``(key, fp, ...)`` for every choice of some of the segments of equal length that a fingerprint is cut
    into, as many as ``max_bits`` bits cannot touch at least: two fingerprints at ``max_bits`` or fewer agree in all
    segments of one choice. Two segments for few nodes, three, which is more selective, for many."""
    agree = 2 if nodes.count() <= FEW_NODES else 3
    cuts = [64 * i // (max_bits + agree) for i in range(max_bits + agree + 1)]
    segments = [(1 << j) - (1 << i) for i, j in zip(cuts, cuts[1:])]
    keys = []
    for n, chosen in enumerate(combinations(segments, agree)):
        mask = sum(chosen)
        bits = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        keys.append(F.struct(F.lit(n).alias("choice"), bits.alias("bits")))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "*")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp, component_id)``, one row per input row.

    ``component_id`` is the smallest ``doc_id`` reachable over links between fingerprints at
    ``MAX_BITS`` bits or fewer, the row's own included. Rows with equal fingerprints (exact copies,
    repeated rows, all texts without words) are one node of the search. A null ``doc_id`` never
    names a component unless its component has no other.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    _, roots = linked(nodes)
    named = nodes.join(roots, "fp").select("fp", "first", "root")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


WORDS, SIMILARITY = 5, 0.8
CANDIDATE_SHINGLE, CANDIDATE_BITS = 2, 5
"""Fingerprints of word pairs lie closer together than those of longer shingles: an edit changes two
pairs instead of five shingles."""


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, shingles)``: hashes of the different shingles; a text of
    fewer words has one, all of it, and a text without words none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column("text"):
                found = words_of(text.as_py())
                parts = (found[i : i + words] for i in range(max(1, len(found) - words + 1))) if found else ()
                hashes = {xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts}
                sets.append(np.array(sorted(hashes), np.uint64).view(np.int64))
            lists = pa.array(sets, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def similar(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of document ids whose sets of shingles have that Jaccard similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(shingle_sets(docs.join(ids, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "shingles")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y") - shared
    return both.where((total == 0) | (shared >= F.lit(similarity) * total)).select("a", "b")


def rooted(nodes: DataFrame, found: DataFrame, node: str, root: str) -> DataFrame:
    """``nodes`` with a column ``root``: the component of the column ``node`` by the links ``found``."""
    roots = components(found).select(F.col("node").alias(node), F.col("root").alias(root))
    return nodes.join(roots, node, "left").withColumn(root, F.coalesce(root, node))


def missed(
    texts: DataFrame, far: DataFrame, held: DataFrame, docs: DataFrame, words: int, similarity: float,
    roots: DataFrame | None = None,
) -> DataFrame:
    """``held`` and further links, so that texts of one candidate component (a cloud of fingerprints) are in
    one group if any chain of pairs of that similarity joins them. ``roots(fp, root)`` are the components of ``far``, if known.

    Only clouds that ``held`` leaves in several groups are searched. Of two texts of the similarity each
    holds one of the other's rarest shingles among its own rarest (as many as may differ, and one), with
    shingles in one order throughout the cloud; these are the join keys. Their positions bound how much two
    texts can share, which ends most comparisons at frequent shingles. Members of a key are first compared with leaders, four for each text; then all pairs of a key that are
    still in different groups are, but for those within the key's most frequent group.
    """
    members = texts.select("fp", F.col("first").alias("doc_id"))
    if roots is None:
        clouds = rooted(members, far, "fp", "cloud")
    else:
        clouds = members.join(roots.withColumnRenamed("root", "cloud"), "fp")
    groups = stored(rooted(clouds.select("cloud", "doc_id").distinct(), held, "doc_id", "root"), "groups")
    split = groups.groupBy("cloud").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    apart = stored(groups.join(split.select("cloud"), "cloud"), "apart")
    if apart.isEmpty():
        return held
    ids = apart.select("doc_id").distinct()
    sets = stored(shingle_sets(docs.join(ids, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "shingles")
    parts = apart.join(sets, "doc_id").select(
        "cloud", "doc_id", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")
    )
    shared = parts.groupBy("cloud", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = parts.join(shared, ["cloud", "shingle"]).groupBy("cloud", "doc_id", "size").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common")
    )
    # the shingles of one text alone are its rarest, and no keys
    keys = F.size("common") + 1 - F.ceil(F.lit(similarity) * F.col("size") - 1e-6).cast("int")
    first = F.slice("common", F.lit(1), F.col("keys"))["shingle"]
    entries = common.withColumn("keys", keys).where("keys > 0").select(
        "cloud", "doc_id", "size", (F.col("size") - F.size("common")).alias("alone"), F.posexplode(first).alias("at", "shingle")
    )
    entries = entries.select("cloud", "doc_id", "size", (F.col("alone") + F.col("at")).alias("pos"), "shingle")
    entries = stored(entries, "entries")
    key = ["cloud", "shingle"]

    def crossing(found: DataFrame) -> DataFrame:
        """Entries of keys that hold several groups, with the key's most frequent group."""
        now = stored(rooted(entries, found, "doc_id", "root"), "members")
        open_ = (
            now.groupBy(*key, "root")
            .agg(F.count("*").alias("n"))
            .groupBy(*key)
            .agg(F.count("*").alias("groups"), F.max(F.struct("n", "root"))["root"].alias("major"))
            .where("groups > 1")
            .drop("groups")
        )
        return stored(now.join(open_, key), "open")

    def fit(x: str, before_x: str, y: str, before_y: str):
        """Whether sets of ``x`` and ``y`` shingles can be similar if the first they share has so many before it."""
        most = F.least(F.col(x) - F.col(before_x), F.col(y) - F.col(before_y))
        return most >= F.lit(similarity / (1 + similarity)) * (F.col(x) + F.col(y)) - 1e-6

    members = crossing(held)
    chance = F.xxhash64("doc_id", "shingle")
    leader = F.struct(F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("pos").alias("pb"))
    led = members.groupBy(*key).agg(F.array(F.min_by(leader, chance), F.max_by(leader, chance)).alias("leaders"))
    tried = (
        members.join(led, key)
        .select(F.col("doc_id").alias("a"), "root", "size", "pos", F.inline("leaders"))
        .where(F.col("root") != F.col("rb"))
        .where(fit("size", "pos", "sb", "pb"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )
    best = Window.partitionBy("a").orderBy(F.col("n").desc(), "b")
    tried = stored(tried.withColumn("n", F.row_number().over(best)).where("n <= 4").select("a", "b"), "tried")
    held = stored(held.union(similar(tried, docs, words, similarity)), "similar")

    members = crossing(held)
    minor = members.where("root <> major").select(
        *key, F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("pos").alias("pa"), "major"
    )
    other = members.select(
        *key, F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("pos").alias("pb")
    )
    # a pair of two minor members is met from both sides
    rest = (
        minor.join(other, key)
        .where(F.col("ra") != F.col("rb"))
        .where((F.col("rb") == F.col("major")) | (F.col("a") < F.col("b")))
        .where(fit("sa", "pa", "sb", "pb"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    return stored(held.union(similar(stored(rest, "rest"), docs, words, similarity)), "similar")


def verified_groups(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    width: int = CANDIDATE_SHINGLE,
    max_bits: int = CANDIDATE_BITS,
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, component_id)`` by links that are checked exactly.

    Links between fingerprints of ``width``-word shingles are candidates; they hold if the texts' sets
    of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more. Copies of a text
    are one node. Of different texts with one fingerprint, each is compared with the first; of linked
    fingerprints, the first texts are. :func:`missed` adds what these comparisons leave out among the
    texts that candidate links hold together. Rows without a ``doc_id`` take no part.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stored(fingerprints(known, width), "fingerprints")
    texts = stored(rows.groupBy("fp", "text_key").agg(F.min("doc_id").alias("first")), "texts")
    nodes = stored(texts.groupBy("fp").agg(F.min("first").alias("first")), "nodes")
    named = nodes.withColumnRenamed("first", "b")
    same = texts.join(named, "fp").where("first <> b").select(F.col("first").alias("a"), "b")
    found, roots = linked(nodes, max_bits)
    far = stored(found.distinct(), "far")
    ends = far.join(nodes.select(F.col("fp").alias("a"), F.col("first").alias("i")), "a").join(
        nodes.select(F.col("fp").alias("b"), F.col("first").alias("j")), "b"
    )
    pairs = stored(same.union(ends.select("i", "j")).distinct(), "pairs")
    held = stored(similar(pairs, known, words, similarity), "similar")
    roots = components(missed(texts, far, held, known, words, similarity, roots))
    least = texts.join(roots, F.col("first") == F.col("node"), "left").select(
        "fp", "text_key", F.coalesce("root", "first").alias("component_id")
    )
    return rows.join(least, ["fp", "text_key"]).select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest ``doc_id``.

    Groups are those of :func:`verified_groups`. All columns are kept as they are. Rows that repeat a
    ``doc_id`` are the same document, one of them stays; rows without a ``doc_id`` cannot represent
    a group and pass unchanged.
    """
    found = verified_groups(docs, words, similarity).where(F.col("doc_id") == F.col("component_id"))
    names = docs.columns
    known = docs.where(F.col("doc_id").isNotNull())
    kept = known.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.dropDuplicates(["doc_id"]).select(names).union(docs.where(F.col("doc_id").isNull()))
