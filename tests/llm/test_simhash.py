import random
import re

import xxhash

from textwarden.llm import simhash


def slow_fingerprint(text, width=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [words] if len(words) <= width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_groups(rows):
    """Groups of documents with a fingerprint distance up to five bits (word pairs) and a Jaccard
    similarity of 0.8 or more (five words), by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [(i, slow_fingerprint(t, 2), shingles(t)) for i, t in rows]
    for n, (i, f, s) in enumerate(known):
        for j, g, r in known[n + 1 :]:
            if bin(f ^ g).count("1") <= 5 and len(s & r) >= 0.8 * len(s | r):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, _ in rows:
        groups.setdefault(find(i), set()).add(i)
    return list(groups.values())


def test_verified_groups_against_brute_force(docs_of, odd_rows):
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = list(odd_rows)
    for i in range(60):  # near copies of one text, some beyond the similarity, and strangers
        words = list(base)
        for at in rng.sample(range(300), rng.choice([0, 1, 2, 4, 8, 30])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((700 + i, " ".join(words)))
    rows += [(800, "short"), (801, "Short"), (802, "other"), (803, "a b c"), (804, "a b c d e f")]
    found = {}
    for r in simhash.verified_groups(docs_of(rows)).collect():
        found.setdefault(r["component_id"], set()).add(r["doc_id"])
    want = slow_groups([(r[0], r[1]) for r in rows if r[0] is not None])
    assert all(min(group) == least for least, group in found.items())
    # every link found holds; few of those at the edge of the similarity are not looked at
    assert all(any(group <= whole for whole in want) for group in found.values())
    assert len(want) <= len(found) <= len(want) + 3
    assert {5, 6, 7} in map(set, found.values()) and {1, 2, 3} in map(set, found.values())


def test_groups_of_texts_with_crowded_fingerprints(docs_of):
    """Texts dominated by one passage: near copies that are not like the first text of their fingerprint."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(51))
    rows = []
    for i in range(30):
        tail = [f"t{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * i, " ".join([passage] * 40 + tail)))
        tail[rng.randrange(20, 280)] = "changed"
        rows.append((2 * i + 1, " ".join([passage] * 40 + tail)))
    want = {}
    sets = {i: shingles(t) for i, t in rows}
    for i, s in sets.items():  # by similarity alone
        want[i] = min(want.get(j, j) for j, r in sets.items() if len(s & r) >= 0.8 * len(s | r))
    found = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(docs_of(rows)).collect()}
    assert found == want and len(set(want.values())) == 30


def test_missed_links_chain_through_any_member(docs_of):
    """Groups that only members other than their smallest join, within one crowd."""
    rng = random.Random(8)
    rows = []
    for chain in range(6):
        words = [f"c{chain}w{i}" for i in range(200)]
        for step in range(12):
            rows.append((100 * chain + step, " ".join(words)))
            for at in rng.sample(range(200), 2):
                words[at] = f"n{rng.randrange(10**9)}"
    rng.shuffle(rows)
    spark = docs_of([]).sparkSession
    texts = spark.createDataFrame([(7, i) for i, _ in rows], "fp bigint, first bigint")
    none = spark.createDataFrame([], "a bigint, b bigint")
    held = simhash.missed(texts, none, none, docs_of(rows), 5, 0.8)
    roots = {r["node"]: r["root"] for r in simhash.components(held).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        for i, s in sets.items():
            want[i] = min(want[j] for j, r in sets.items() if len(s & r) >= 0.8 * len(s | r))
    assert {i: roots.get(i, i) for i in sets} == want
    assert all(len(sets[r["a"]] & sets[r["b"]]) >= 0.8 * len(sets[r["a"]] | sets[r["b"]]) for r in held.collect())


def test_fingerprints(odd_rows):
    for _, text, *_ in odd_rows:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint("A b c É") == slow_fingerprint("a b c É")


def test_near_duplicates_against_brute_force(docs_of, odd_rows):
    found = simhash.near_duplicates(docs_of(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    fps = {}
    for doc_id, text, *_ in odd_rows:
        fp = slow_fingerprint(text)
        fps.setdefault(fp - (1 << 64) if fp >> 63 else fp, []).append(doc_id)
    roots = slow_components(fps)
    least = {}
    for fp, ids in fps.items():
        known = [i for i in ids if i is not None]
        if known:
            least[roots[fp]] = min(known + [least.get(roots[fp], known[0])])
    for row in found:
        assert row["doc_id"] in fps[row["fp"]]
        assert row["component_id"] == least.get(roots[row["fp"]])


def test_links_join_what_brute_force_joins(spark):
    """Chains and clouds of fingerprints a few bits apart, and strangers."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) - 2**63 for _ in range(300)}
    for base in list(values)[:6]:
        at = base
        for step in range(60):
            for bit in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5])):
                at ^= 1 << bit
            at = (at + 2**63) % 2**64 - 2**63
            values.add(at)
            if step % 3:
                at = base
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    links = simhash.links(nodes)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {v: roots.get(v, v) for v in values} == slow_components(values)
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in links.collect())


def test_keep_first(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 3  # rows without an id pass
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and 5 in named and 6 not in named and 1 in named and 2 not in named


def test_empty_table(docs_of):
    docs = docs_of([])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_first(docs).count() == 0


def test_near_copies_are_joined_by_whole_segments(spark):
    """A group of near-copies is one component before the wildcard keys are looked at: few links for each of them."""
    rng = random.Random(6)
    base = rng.getrandbits(62)
    values = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i) if i < 63}
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    links = simhash.links(nodes)
    found = links.count()
    assert len({r["root"] for r in simhash.components(links).collect()}) == 1
    assert found <= 4 * len(values)


def test_components_of_linked_fingerprints(spark):
    """A wide group of near-copies and strangers: components as by brute force, and few links."""
    rng = random.Random(9)
    base = rng.getrandbits(63)
    values = {base} | {rng.getrandbits(63) for _ in range(100)}
    for _ in range(500):
        at = base
        for bit in rng.sample(range(63), rng.choice([2, 3, 3, 5, 6])):
            at ^= 1 << bit
        values.add(at)
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    links, roots = simhash.linked(nodes)
    found = {r["fp"]: r["root"] for r in roots.collect()}
    assert found == slow_components(values)
    assert links.count() <= 20 * len(values)


def test_stored_keeps_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    kept = lambda: {f for f in (files().apply(i).getName() for i in range(files().size())) if f.startswith("shuffle_")}
    before = kept()
    found = simhash.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert found.count() == 7
    # the count itself may leave files of its own
    assert len({f.split("_")[1] for f in kept() - before}) <= 1


def test_finer_keys_are_few_and_complete(spark, monkeypatch):
    """Fingerprints at the distance share a key, whatever bits differ; a node has so many keys, in however many it was met."""
    rng = random.Random(12)
    pairs = []
    for bits in (0, 4, 5):
        for _ in range(60):
            a = rng.getrandbits(64)
            b = a
            for at in rng.sample(range(64), bits):
                b ^= 1 << at
            pairs.append((bits, a - 2**63, (b - 2**63)))
    nodes = spark.createDataFrame([(v,) for _, a, b in pairs for v in (a, b)], "fp bigint").distinct()
    for few, keys in ((1 << 17, {4: 15, 5: 21}), (0, {4: 35, 5: 56})):
        monkeypatch.setattr(simhash, "FEW_NODES", few)
        for most, number in keys.items():
            found = {}
            for row in simhash.finer_keys(nodes, most).collect():
                found.setdefault(row["fp"], set()).add(tuple(row["key"]))
            assert {len(k) for k in found.values()} == {number}
            assert all(found[a] & found[b] for bits, a, b in pairs if bits <= most)


def test_reading_a_stored_table_leaves_no_direct_buffers(spark):
    from pyspark.sql import functions as F

    factory = spark._jvm.java.lang.management.ManagementFactory
    kind = spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")

    def direct():
        return next(p.getMemoryUsed() for p in factory.getPlatformMXBeans(kind) if p.getName() == "direct")

    wide = spark.range(0, 20_000, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: F.xxhash64("id", x)).alias("x"))
    found = simhash.stored(wide, "wide")  # 16 MB
    before = direct()
    assert found.agg(F.sum(F.aggregate("x", F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b)))).count() == 1
    assert found.agg(F.max(F.xxhash64("x"))).first()[0] is not None
    assert direct() - before < 4 << 20
