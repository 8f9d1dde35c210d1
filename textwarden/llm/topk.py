"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are cut into ``LISTS`` slices. A query's score of a candidate is the sum
of its partial scores over the slices, so every slice is a list of partial scores, computed by
tasks that hold nothing but that slice.

1. Every list gives its best entries and its least one for each query. The candidates seen are
   scored exactly; the k-th best of them is a lower bound ``tau`` of the final k-th score.
2. A candidate whose partial score in each list is under ``least + (tau - sum of leasts) / LISTS``
   has a sum under ``tau``. That cutoff goes out to all lists, and they give all entries at or
   above it. What an entry's candidate may have in the lists that did not name it is bounded by
   their cutoffs; candidates whose bound is under ``tau`` go.
3. The remaining candidates are scored exactly.

Everything is integer arithmetic. Queries and candidates are packed into blocks, and a task holds
one slice of one block of queries and one of candidates. Entries of the second phase travel as
positions within two blocks, and meet the whole vectors as blocks: a vector is sent once for each
block it meets, not once for each entry. The blocks are met by sorted joins: once each is repeated
for all the others, a side is far larger than its plan tells, and must not be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import stored
from textwarden.llm.vectors import matrix, queries_of, representatives, top_rows, usable

LISTS = 2
SEEDS = 24
"""Entries that each list gives in the first phase, for each query."""

QUERY_BLOCK, BLOCK = 1024, 4096
SAFE, SAFE_SINGLE = 1 << 52, 1 << 24
ROWS = 1 << 16
"""Pairs whose components a task sets beside each other at once."""


def quantised(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, v)`` with ``v`` the components' ``floor(scale * x)``, as longs."""
    rows = usable(vectors, id_column, vector_column)
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))
    return rows.select("vec_id", whole.alias("v")).distinct()


def exact_kind(x: np.ndarray, y: np.ndarray) -> type:
    """The numbers in which no sum of ``x``'s and ``y``'s products is rounded: single ones where none can
    reach 2^24, doubles below 2^52, else 64-bit integers."""
    if not x.size or not y.size:
        return np.int64
    most = [max(float(z.max()), -float(z.min())) for z in (x, y)]
    bound = most[0] * most[1] * x.shape[1]
    return np.float32 if bound < SAFE_SINGLE else np.float64 if bound < SAFE else np.int64


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact ``x @ y.T`` as integers, of 32 bits where they suffice."""
    kind = exact_kind(x, y)
    return (x.astype(kind) @ y.T.astype(kind)).astype(np.int32 if kind is np.float32 else np.int64, copy=False)


def dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of the rows ``x[i]`` and ``y[j]``, pair by pair."""
    kind = exact_kind(x, y)
    x, y, out = x.astype(kind), y.astype(kind), np.zeros(len(i), np.int64)
    for at in range(0, len(i), ROWS):
        part = slice(at, at + ROWS)
        out[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]])
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` as the shortest integers that hold it."""
    for kind in (np.int16, np.int32):
        if not x.size or np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(np.int64)


PACKED = "dims int, list int, block int, width int, ids binary, data binary, low binary"


def pack(rows: DataFrame, blocks: dict[int, int], lists: int) -> DataFrame:
    """``rows(rep, v[, cut])`` -> one row per block and slice, ids and numbers as bytes, and one with
    the whole vectors, under the number that follows the lists'.

    ``cut`` holds a query's cutoff for every list, then its ``tau``; the whole vectors get all of it."""
    names = [name.split()[0] for name in PACKED.split(", ")]
    number = F.lit(1)
    for dims, n in blocks.items():
        number = F.when(F.size("v") == dims, F.lit(n)).otherwise(number)
    cut = F.col("cut") if "cut" in rows.columns else F.lit(None).cast("array<bigint>")
    dealt = rows.select(
        F.size("v").alias("dims"), F.pmod(F.xxhash64("rep"), number).cast("int").alias("block"), "rep", "v", cut.alias("cut")
    )

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"))
        dims, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        low = matrix(table.column("cut")) if table.column("cut").null_count == 0 else None
        ids = table.column("rep").to_numpy().astype(np.int64).tobytes()
        out = []
        for i, part in enumerate([*np.array_split(np.arange(dims), lists), np.arange(dims)]):
            data = narrow(x[:, part]).tobytes()
            cuts = None if low is None else (low[:, i] if i < lists else low).astype(np.int64).tobytes()
            out.append((dims, i, block, len(part), ids, data, cuts))
        types = (*[pa.int32()] * 4, *[pa.binary()] * 3)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return dealt.groupBy("dims", "block").applyInArrow(run, PACKED)


def paired(
    asked: DataFrame, held: DataFrame, asked_blocks: dict[int, int], held_blocks: dict[int, int], only: int | None = None
) -> DataFrame:
    """Every block of queries with every block of candidates, slice by slice (or the slice ``only``),
    each pair a row of its own key."""

    def others(blocks: dict[int, int]):
        number = F.lit(1)
        for dims, n in blocks.items():
            number = F.when(F.col("dims") == dims, F.lit(n)).otherwise(number)
        return F.explode(F.sequence(F.lit(0), number - 1))

    if only is not None:
        asked, held = asked.where(F.col("list") == only), held.where(F.col("list") == only)
    left = asked.select("dims", "list", F.col("block").alias("qb"), others(held_blocks).alias("cb"), "width",
                        F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "low")
    right = held.select("dims", "list", F.col("block").alias("cb"), others(asked_blocks).alias("qb"),
                        F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    if only is None:
        return left.hint("merge").join(right, ["dims", "list", "qb", "cb"])
    return left.hint("merge").join(right.drop("list"), ["dims", "qb", "cb"])


ENTRIES = "q bigint, c bigint, list int, partial bigint"
NAMED = "dims int, qb int, cb int, at binary, partial binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _numbers(data: bytes, rows: int, width: int) -> np.ndarray:
    if not rows * width:
        return np.zeros((rows, width), np.int64)
    return np.frombuffer(data, f"i{len(data) // (rows * width)}").reshape(rows, width)


def _blocks(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the queries and candidates, and their numbers."""
    q, c = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
    return q, c, _numbers(row["q_data"], len(q), row["width"]), _numbers(row["c_data"], len(c), row["width"])


def _entries(q: np.ndarray, c, of: int, partial: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q), c, pa.array(np.full(len(q), of, np.int32)), pa.array(partial, pa.int64())],
        ["q", "c", "list", "partial"],
    )


def _best_of(partial: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` highest entries of each row, and their candidates."""
    n = min(n, partial.shape[1])
    at = np.argpartition(partial, partial.shape[1] - n, axis=1)[:, partial.shape[1] - n :]
    return np.take_along_axis(partial, at, 1).astype(np.int64), c[at] if c.ndim == 1 else np.take_along_axis(c, at, 1)


def first_phase(pairs: DataFrame, seeds: int) -> DataFrame:
    """Best entries of every list within a task, and its least partial score (``c`` null).

    Blocks of candidates that follow each other for one block of queries are merged; the joins sort
    them so."""

    def told(of: int, q: np.ndarray, least: np.ndarray, partial: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _entries(q, pa.nulls(len(q), pa.int64()), of, least)
        yield _entries(np.repeat(q, c.shape[1]), pa.array(c.ravel()), of, partial.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None
        for row in _rows(batches):
            q, c, x, y = _blocks(row)
            scores = products(x, y)
            least, (partial, c) = scores.min(axis=1).astype(np.int64), _best_of(scores, c, seeds)
            now = (row["dims"], row["list"], row["qb"], row["q_ids"])
            if key == now:
                least = np.minimum(held[2], least)
                partial, c = _best_of(np.hstack([held[3], partial]), np.hstack([held[4], c]), seeds)
            elif held is not None:
                yield from told(*held)
            key, held = now, (row["list"], q, least, partial, c)
        if held is not None:
            yield from told(*held)

    return pairs.drop("low").mapInArrow(run, ENTRIES)


def second_phase(pairs: DataFrame) -> DataFrame:
    """All entries at or above the query's cutoff for the list: a row per pair of blocks, with their
    places in the matrix of its queries and candidates, row by row, and their partial scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, x, y = _blocks(row)
            scores = products(x, y)
            whole = np.iinfo(scores.dtype)
            low = np.clip(np.frombuffer(row["low"], np.int64), whole.min, whole.max).astype(scores.dtype)
            at = np.flatnonzero(scores >= low[:, None])
            partial = scores.ravel()[at]
            out = [[row["dims"]], [row["qb"]], [row["cb"]], [at.astype(np.uint32).tobytes()], [partial.tobytes()]]
            types = (*[pa.int32()] * 3, *[pa.binary()] * 2)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], [n.split()[0] for n in NAMED.split(", ")])

    return pairs.mapInArrow(run, NAMED)


def third_phase(pairs: DataFrame, named: list[DataFrame], n: int) -> DataFrame:
    """Whole ``pairs`` of blocks and every list's entries -> ``(q, c, score)``: the pairs that may
    reach ``tau``, scored exactly, and of those that do each query's ``n`` best in a block."""
    for i, entries in enumerate(named):
        entries = entries.withColumnsRenamed({"at": f"at{i}", "partial": f"partial{i}"})
        pairs = pairs.join(entries.hint("merge"), ["dims", "qb", "cb"])
    lists = len(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q, c, x, y = _blocks(row)
            low = np.frombuffer(row["low"], np.int64).reshape(len(q), lists + 1)
            cut, tau = low[:, :lists], low[:, lists]
            given = []
            for k in range(lists):
                at = np.frombuffer(row[f"at{k}"], np.uint32)
                given.append((at, np.frombuffer(row[f"partial{k}"], f"i{len(row[f'partial{k}']) // max(1, len(at)) or 8}")))
            at = np.unique(np.concatenate([places for places, _ in given]))
            i, j = np.divmod(at.astype(np.int64), len(c))
            # the most that the lists can add which did not name the candidate
            bound = (cut - 1).sum(axis=1)[i]
            for k, (places, partial) in enumerate(given):
                where = np.searchsorted(at, places)
                bound[where] += partial - (cut[i[where], k] - 1)
            possible = bound >= tau[i]
            i, j = i[possible], j[possible]
            score = dots(x, y, i, j)
            reached = score >= tau[i]
            i, j, score = i[reached], j[reached], score[reached]
            order = np.lexsort((c[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < n
            yield pa.RecordBatch.from_arrays([pa.array(q[i[top]]), pa.array(c[j[top]]), pa.array(score[top])], ["q", "c", "score"])

    return pairs.mapInArrow(run, "q bigint, c bigint, score bigint")


def exact(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs(q, c)`` -> ``(q, c, score)``, from the whole vectors. Files tell little of the vectors'
    size in memory, so that they are joined by sorting as well."""
    joined = pairs.join(reps.select(F.col("rep").alias("q"), F.col("v").alias("x")).hint("merge"), "q").join(
        reps.select(F.col("rep").alias("c"), F.col("v").alias("y")).hint("merge"), "c"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column("x")))
            for dims in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                x, y = matrix(part.column("x")), matrix(part.column("y"))
                score = pa.array((x.astype(np.int64) * y.astype(np.int64)).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("c"), score], ["q", "c", "score"])

    return joined.select("q", "c", "x", "y").mapInArrow(run, "q bigint, c bigint, score bigint")


def best(scored: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "c"))
    return scored.withColumn("n", rank).where(F.col("n") <= n).drop("n")


def _block_counts(reps: DataFrame, size: int) -> dict[int, int]:
    counts = reps.groupBy(F.size("v").alias("dims")).count().collect()
    return {r["dims"]: math.ceil(r["count"] / size) for r in counts}


def search(
    vectors: DataFrame,
    k: int,
    every: int,
    *,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    lists: int = LISTS,
    seeds: int = SEEDS,
    query_block: int = QUERY_BLOCK,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row whose id is divisible by
    ``every``: ``(query_id, rank, vec_id, score)``, ties to the smaller id, the row itself left out.

    Components become ``floor(scale * x)``; scores are exact while they fit in 64 bits. Null and
    empty vectors, and such with null or non-finite components, take no part, nor do rows without an
    id; zero vectors do. Vectors are compared with those of their own length. Copies of a vector
    are searched once (see :func:`representatives`).
    """
    rows = stored(quantised(vectors, scale, id_column, vector_column), "vectors")
    reps = stored(representatives(rows, k + 1), "representatives")
    queries = stored(queries_of(rows, reps, every), "queries")
    asked = stored(reps.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v"), "asked")
    held_blocks, asked_blocks = _block_counts(reps, block), _block_counts(asked, query_block)
    held = stored(pack(reps, held_blocks, lists), "candidates")

    pairs = paired(pack(asked, asked_blocks, lists), held, asked_blocks, held_blocks).where(F.col("list") < lists)
    first = stored(first_phase(pairs, seeds), "first")
    least = first.where("c is null").groupBy("q", "list").agg(F.min("partial").alias("least"))
    rank = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.col("partial").desc(), "c"))
    seen = first.where("c is not null").withColumn("n", rank).where(F.col("n") <= seeds)
    tau = (
        best(exact(seen.select("q", "c").distinct(), reps), k + 1)
        .groupBy("q")
        .agg(F.min("score").alias("tau"), F.count("*").alias("n"))
        .where(F.col("n") == k + 1)
    )
    # cutoff of a list: least + ceil((tau - sum of leasts) / lists); without tau, all entries and any score
    leasts = least.groupBy("q").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("list", "least"))), lambda x: x["least"]).alias("leasts")
    )
    total = F.aggregate("leasts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    gap = F.coalesce(F.ceil((F.col("tau") - total) / F.lit(lists)), F.lit(0)).cast("bigint")
    none = F.lit(-(1 << 63)).cast("bigint")
    cuts = stored(
        leasts.join(tau, "q", "left").select(
            F.col("q").alias("rep"),
            F.concat(
                F.transform("leasts", lambda x: x + F.greatest(gap, F.lit(0))), F.array(F.coalesce("tau", none))
            ).alias("cut"),
        ),
        "cutoffs",
    )
    # stored, since the lists' entries tell a query by its place in the block
    cut_asked = stored(pack(asked.join(cuts, "rep"), asked_blocks, lists), "queries")
    named = [second_phase(paired(cut_asked, held, asked_blocks, held_blocks, i)) for i in range(lists)]
    found = third_phase(paired(cut_asked, held, asked_blocks, held_blocks, lists), named, k + 1)
    return top_rows(best(found, k + 1), reps, queries, k)
