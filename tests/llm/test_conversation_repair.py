"""Conversation repair against all edits of short conversations, and a plain search for longer ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

from textwarden.llm import conversation_repair as repair
from textwarden.llm import queries

LEGAL = re.compile(r"(s?(ua)+)?")
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def damaged(rows):
    """The contract's damage, row by row: ``(conv_id, turn, role, text)``."""
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def judged(rows):
    """``(role, text, fault)`` of a conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else None
        fault = fault or (None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def moves(row, state):
    """Edits of a row after ``state`` (the initials so far, shortened): letter, cost, new role."""
    role, _, fault = row
    yield "D", 4, None
    if fault in ("blank", "duplicate"):
        return
    extra = 3 if fault == "truncated" else 0
    yield "K", extra, role
    for other in ("user", "assistant"):
        yield "R", 3 + extra, other


def exhaustive(rows):
    """Smallest (cost, audit, repaired) of all edits with up to two insertions in a place."""
    best = None
    inserts = [()] + [c for n in (1, 2) for c in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*[list(moves(row, None)) for row in rows]):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, kept = 0, "", []
            for i, places in enumerate(added):
                cost, audit, kept = cost + 3 * len(places), audit + "I" * len(places), kept + [(r, "") for r in places]
                if i < len(rows):
                    letter, price, role = edits[i]
                    cost, audit = cost + price, audit + letter
                    kept += [(role, rows[i][1])] if role is not None else []
            if LEGAL.fullmatch("".join(role[:1] or "?" for role, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, kept
    return best


def search(rows):
    """The same by recursion over the rows and the last initial."""

    @lru_cache(None)
    def rest(i, last):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        options = [(0, "", (), last)]
        for _ in range(2):
            new = []
            for cost, letters, kept, at in options:
                role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[at]
                new.append((cost + 3, letters + "I", (*kept, (role, "")), role[0]))
            options += new
        for cost, letters, kept, at in {o[:2] + o[2:]: o for o in options}.values():
            if i == len(rows):
                if at in ("", "a"):
                    found.append((cost, letters, kept))
                continue
            for letter, price, role in moves(rows[i], at):
                to = at if role is None else role[:1]
                fits = role is None or (at + to) in ("s", "u", "su", "ua", "au")
                if role is not None and (not fits or to == ""):
                    continue
                more = rest(i + 1, to)
                if more is not None:
                    own = () if role is None else ((role, rows[i][1]),)
                    found.append((cost + price + more[0], letters + letter + more[1], kept + own + more[2]))
        return min(found, key=lambda f: f[:2]) if found else None

    return rest(0, "")


def brute(rows, solve=search):
    out = []
    for conv in {row[0] for row in rows}:
        mine = damaged([row for row in rows if row[0] == conv])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[1] for r in mine if r[1] is not None]
        found = judged(mine)
        faults = [f for _, _, f in found]
        initials = [role[:1] for role, _, _ in found]
        cost, audit, kept = solve(tuple(found)) if found else (0, "", ())
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        out.append(
            (
                conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *[faults.count(kind) for kind in ("blank", "duplicate", "truncated")],
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                cost, audit, hashlib.sha256(text.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def got(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(row) for row in df.select(*names).collect()), key=str)


def random_rows(rng, convs, most):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(most + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["a.", "b?", "c!  \n", "d", "e ", "", " \t", None, "f\x85", f"x{turn}.", f"y{turn}"])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2) * 40, role, text))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    return rows + [r for r in rows if rng.random() < 0.1]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, h1 string, part string, cost int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*row, 7, "x", None, 0) for row in rows], SCHEMA).repartition(parts)


def solved(spark, rows, block=repair.BLOCK):
    turns = table(spark, rows)
    return got(repair.repair(repair.damage(turns), turns, block))


def test_search_equals_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = judged(damaged([r for r in random_rows(rng, 1, 3)]))[:2]
        if rows:
            assert search(tuple(rows)) is not None
            assert exhaustive(rows)[:2] == search(tuple(rows))[:2]


def test_paths_compose():
    """Blocks of any size give the repair of the whole."""
    rng = random.Random(6)
    for _ in range(200):
        rows = [
            (rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice([None, None, "blank", "truncated"]))
            for _ in range(rng.randrange(1, 30))
        ]
        want = search(tuple(rows))
        size = rng.randrange(1, 9)
        now = repair._Conversation(1)
        steps = [(r[0][:1], r[2] == "blank", r[2] == "truncated") for r in rows]
        out = []
        for at in range(0, len(rows), size):
            part = steps[at : at + size]
            names = ("start", "end", "cost", "letters")
            found = [dict(zip(names, p)) for p in repair.paths(part, repair.STATES if at else (repair.START,))]
            sources = [
                None if lost else {"turn": at + i, "role": rows[at + i][0], "h1": 0, "h2": 0}
                for i, (_, lost, _) in enumerate(part)
            ]
            block = {"illegal": 0, "head": part[0][0], "tail": part[-1][0], "sources": sources, "paths": found}
            out += now.add(block)
        out += now.end()
        assert (out[-1]["cost"], out[-1]["audit"]) == want[:2]


def test_odd_rows(spark):
    rng = random.Random(7)
    rows = random_rows(rng, 60, 12) + [
        (None, 1, "user", "no id."), (None, 2, "assistant", "yes."), (None, None, None, None),
        (900, None, "user", "only null turns."), (901, 5, None, None),
    ]
    long = "word " * 40_000 + "."
    rows += [(902, t, ("user", "assistant")[t % 2], long if t == 3 else f"turn {t}.") for t in range(400)]
    want = brute(rows)
    assert solved(spark, rows) == want
    assert solved(spark, rows, block=3) == want


def test_no_rows_and_dropped_conversations(spark):
    assert solved(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert solved(spark, [(gone, 1, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", repair.EMPTY)]


def test_many_repeats_of_one_row(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 > 4)
    assert solved(spark, [(conv, 1, "user", "x.")] * 1000, block=50)[0][2:8] == (0, 999, 0, 999, 3999, "K" + "D" * 999 + "I")


def test_query(spark, data):
    import duckdb

    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{data}/conversations.parquet'").fetchall()
    assert got(queries.registry()["op11_conversation_repair"](spark, data)) == brute(rows)
