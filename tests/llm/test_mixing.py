import re
from collections import defaultdict

import pytest

from textwarden.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: rest * weight[s] / total for s in open_}
        rest = 0.0
        for s, more in given.items():
            take = min(more, most * sizes[s] - target[s])
            target[s] += take
            rest += more - take
            if target[s] >= most * sizes[s] - 1e-9:
                open_.discard(s)
    return target


def check(docs, rows, group=mixing.GROUP, slack=None):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    target = slow_targets(sizes)
    found = mixing.mix(docs, group=group).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["size"]) for r in found), key=str) == sorted(
        ((r[0] is None, r[0], words(r[1])) for r in rows), key=str
    )
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        if sizes[r["source"]]:
            rate = target[r["source"]] / sizes[r["source"]]
            assert r["size"] == 0 or int(rate + 1e-9) <= r["copies"] <= int(rate - 1e-9) + 1
        taken[r["source"]] += r["taken"]
    largest = max((words(r[1]) for r in rows), default=0)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= (largest if slack is None else slack)
    return found


def test_odd_rows(docs_of, odd_rows):
    check(docs_of(odd_rows), odd_rows)


def test_levels_and_reruns(docs_of):
    """A small group size makes a tree of several levels; one source holds most rows."""
    rows = [(i, "w " * (1 + i * 7 % 40), "en", "a" if i % 3 else f"s{i % 5}") for i in range(600)]
    one = check(docs_of(rows), rows, group=8, slack=45)
    two = check(docs_of(rows, parts=7), rows, group=8)
    assert {r["doc_id"]: r["taken"] for r in one} == {r["doc_id"]: r["taken"] for r in two}


def test_caps_bind(docs_of):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate("a" * 3 + "b" * 200 + "c" * 100)]
    check(docs_of(rows), rows, slack=12)


def test_take_mix(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"]] += 1
    assert dict(got) == {k: n for k, n in copies.items() if n}


def test_empty_tables(docs_of):
    assert mixing.mix(docs_of([])).count() == 0 and mixing.take_mix(docs_of([])).count() == 0
    blank = docs_of([(1, None, None, "a"), (2, " ", None, None)])
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


def test_no_python_in_the_plan(docs_of, odd_rows):
    plan = mixing.take_mix(docs_of(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_are_shuffled_once(docs_of, odd_rows):
    """Dropping repeated rows and joining their copies share one shuffle."""
    docs = docs_of(odd_rows)
    conf = docs.sparkSession.conf
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: conf.get(name) for name in names}
    try:
        for name, value in names.items():
            conf.set(name, value)
        plan = mixing.take_mix(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            conf.set(name, value)
    # the join's side that has the texts: their aggregates and sorts over one exchange
    assert "Join [_tw_id" in plan
    side = plan[plan.index("Join [_tw_id") :]
    side = side[side.index("first(text") :]
    side = side[: side.index("Scan ExistingRDD")]
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(_tw_id" in line]
    assert len(shuffles) == 2  # texts, copies
    assert side.count("Exchange hashpartitioning(") == 1
