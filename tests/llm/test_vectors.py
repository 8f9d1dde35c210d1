import numpy as np
import pytest

from textwarden.llm import ann, topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, rep string, v int, q string, ids int"


@pytest.fixture(scope="module")
def table(spark):
    """Ties, copies, repeated rows, vectors of two lengths, and all kinds that take no part."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(90)]  # copies, queries among them
    rows += [(2000 + i, rng.normal(size=3).round(1).tolist()) for i in range(60)]
    rows += [(3000 + i, (-np.array(rows[i][1])).tolist()) for i in range(40)]
    rows += [rows[0], rows[20], (None, [1.0] * 8), (4000, None), (4020, []), (4040, [float("nan")] * 8)]
    rows += [(4060, [1.0, None, *[0.0] * 6]), (4080, [float("inf")] * 8), (4100, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)
    return rows, df


def slow(rows, k, every, transform, zero):
    known = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        known[i] = transform(np.array(v, np.float32).astype(np.float64))
    out = {}
    for q, x in known.items():
        if q % every == 0:
            scored = [(-(x @ y), i) for i, y in known.items() if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: found for q, found in out.items() if found}


def lists(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_topk_against_brute_force(table):
    rows, df = table
    want = slow(rows, 5, 20, lambda x: np.floor(256 * x).astype(np.int64), True)
    for sizes in ({}, {"query_block": 7, "block": 40, "seeds": 3}, {"lists": 5, "seeds": 1}):
        assert lists(topk.search(df, 5, 20, **sizes).collect()) == want


def test_topk_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (51, [-1.0])], "vec_id bigint, embedding array<float>")
    assert lists(topk.search(df, 5, 50).collect()) == {
        0: [(50, 131072), (51, -65536)], 50: [(0, 131072), (51, -131072)],
    }


def test_topk_large_numbers_stay_exact():
    x = np.array([[2**30 + 1, 3]], np.int64)
    assert topk.products(x, x).tolist() == [[(2**30 + 1) ** 2 + 9]]


def test_topk_pairs_of_any_size_stay_exact():
    rng = np.random.default_rng(5)
    for most, kind in ((100, np.int16), (2**17, np.int32), (2**29, np.int32), (2**31, np.int64)):
        x, y = rng.integers(-most, most, (2, 50, 3))
        x[0] = most
        x[1] = -most
        y //= 4  # the sums fit in 64 bits
        want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in y] for u in x]
        assert topk.narrow(x).dtype == kind and topk.narrow(x).tolist() == x.tolist()
        assert topk.products(topk.narrow(x), topk.narrow(y)).tolist() == want
        i, j = np.divmod(np.arange(2500), 50)
        assert topk.dots(topk.narrow(x), topk.narrow(y), i, j).reshape(50, 50).tolist() == want


def test_topk_blocks_are_not_broadcast(spark):
    """A small table of packed queries is a large one when each block is repeated for every block of candidates."""
    rows = spark.createDataFrame([(i, [i, -i, 2]) for i in range(500)], "rep bigint, v array<bigint>")
    asked, held = (topk.stored(topk.pack(rows, {3: n}, 2), "packed") for n in (2, 20))
    for only, n in (((), 120), ((0,), 40), ((2,), 40)):
        pairs = topk.paired(asked, held, {3: 2}, {3: 20}, *only)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert pairs.count() == n


def test_topk_names_entries_by_block(spark):
    """The second phase gives a row per pair of blocks, however many entries are at the cutoff."""
    rows = spark.createDataFrame(
        [(i, [i, 1], [5, 0, -(2**63)]) for i in range(64)], "rep bigint, v array<bigint>, cut array<bigint>"
    )
    asked, held = (topk.stored(topk.pack(t, {2: n}, 2), "packed") for t, n in ((rows, 2), (rows.drop("cut"), 4)))
    named = [topk.second_phase(topk.paired(asked, held, {2: 2}, {2: 4}, i)) for i in range(2)]
    assert [t.count() for t in named] == [8, 8]
    found = topk.third_phase(topk.paired(asked, held, {2: 2}, {2: 4}, 2), named, 64).collect()
    assert {(r["q"], r["c"], r["score"]) for r in found} == {(i, j, i * j + 1) for i in range(64) for j in range(64)}
    assert len(found) == 64 * 64


def test_topk_outliers_and_long_vectors(spark):
    """Lists whose least scores lie far off name nearly everything; seeds that come from one block or from many."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) + 2).round(2).tolist()) for i in range(200)]
    rows += [(300, [-500.0] * 3 + [0.0] * 3), (301, [3000.0] * 6), (302, [-(2.0**21)] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    want = slow(rows, 5, 20, lambda x: np.floor(256 * x).astype(np.int64), True)
    for sizes in ({"query_block": 3, "block": 20, "seeds": 2}, {"lists": 3, "seeds": 1}):
        assert lists(topk.search(df, 5, 20, **sizes).collect()) == want


def test_ann_visits_everything_when_asked_to(table):
    """With the whole probability as target, the search is exact."""
    rows, df = table
    want = slow(rows, 20, 20, lambda x: x, False)
    got = lists(ann.nearest(df, 20, 20, reach=3.0, target=0.99999, width=6.0, chunk=30).collect())
    assert got.keys() == want.keys()
    hits = total = 0
    for q, found in want.items():
        scores = {i: s for i, s in found}
        assert len(got[q]) <= 20
        for i, s in got[q]:
            assert i not in scores or s == pytest.approx(scores[i], abs=1e-9)
        hits += len(scores.keys() & {i for i, _ in got[q]})
        total += len(found)
    assert hits / total > 0.98
    # of copies, the smallest other ones
    copies = [i for i, _ in got[1000] if 1000 <= i < 2000]
    assert copies == list(range(1001, 1001 + len(copies))) == [i for i, _ in want[1000] if 1000 <= i < 2000]


def test_ann_recall(spark, data):
    df = spark.read.parquet(f"{data.replace('0.001', '0.01')}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = slow(rows, 20, 20, lambda x: x, False)
    got = lists(ann.nearest(df, 20, 20).collect())
    recall = np.mean([len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) / len(want[q]) for q in want])
    assert recall >= 0.9


def unequal(kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=({"few": 12, "forty": 40}.get(kind, 1500), 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[7] *= 10
    if kind == "lognormal":
        x *= np.exp(rng.normal(0, 0.7, (len(x), 1)))
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["one long", "lognormal", "forty", "few"])
def test_ann_recall_whatever_the_norms(spark, kind):
    rows = unequal(kind)
    every = 30 if len(rows) > 100 else 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = slow(rows, 20, every, lambda x: x, False)
    got = lists(ann.nearest(df, 20, every).collect())
    assert all(len(got[q]) == len(want[q]) for q in want)
    recall = np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want])
    print(kind, recall)
    assert recall >= (1 if kind == "few" else 0.9)


def test_probes_come_in_order_of_their_share():
    fraction = np.array([0.1, 0.8, 0.5])
    seen = list(ann.probes(fraction, 0.7, 0.9))
    share = lambda d, f: ann._share((d + 1 - f) / 0.7) - ann._share((d - f) / 0.7)
    worth = [np.prod([share(d, f) for d, f in zip(step, fraction)]) for step in seen]
    assert len(set(seen)) == len(seen) and seen[0] == (0, 0, 0)
    assert all(a >= b - 1e-12 for a, b in zip(worth, worth[1:])) and sum(worth[:-1]) < 0.9 <= sum(worth)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(df, 20, 20).count() == 0 and topk.search(df, 5, 50).count() == 0


def test_representatives_keep_the_smallest_ids(spark):
    rows = spark.createDataFrame([(i, [1.0]) for i in range(50)] + [(99, [2.0])], "vec_id bigint, v array<double>")
    found = {tuple(r["v"]): (r["rep"], r["ids"]) for r in vectors.representatives(rows, 3).collect()}
    assert found == {(1.0,): (0, [0, 1, 2]), (2.0,): (99, [99])}
