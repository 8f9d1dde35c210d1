"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products become distances by one more component, ``sqrt(longest^2 - |x|^2)`` for candidates
and 0 for queries; queries are scaled to the longest vector's length, which does not change their
order of candidates. ``TABLES`` tables hash a vector to the cells ``floor((a.x + b) / w)`` of
``hashes`` Gaussian directions. In every table a query visits its own bucket and perturbed ones, in
order of the estimated probability that a neighbour at a distance lies there (the product
over directions of a normal curve's share in the cell), until the visited share is a target.
The candidates of a bucket are scored exactly where they lie; the best of all tables are merged.

The distance comes from the data, by query. A first pass visits little (``FIRST``, at ``REACH``); the score of
the last of the hits wanted bounds those of the true neighbours from below, hence their distance from
above, whatever the norms. The second pass visits ``TARGET`` at that distance, or at the largest there
is if the hits were too few. Queries still short of hits are compared with all vectors of their length.

Buckets are divided into chunks of about ``CHUNK`` vectors, and their visitors into chunks of as many
queries; every chunk of one meets every chunk of the other, so no task's size follows the largest
bucket. No candidate is left out of a visited bucket.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import stored
from textwarden.llm.vectors import matrix, queries_of, representatives, top_rows, usable

TABLES = 4
WIDTH = 2.0
REACH = 1.08
FIRST = 0.2
TARGET = 0.55
FARTHEST = 2.0
"""Distance of opposite unit vectors."""

NEAREST = 0.05
"""Smaller distances are searched as this one, as a bucket of no width has no share."""

CHUNK = 8192
SEED = 7


@dataclass
class Hashes:
    """The tables' directions and offsets for vectors of one length, all drawn from the seed."""

    longest: float
    hashes: int
    width: float
    tables: int = TABLES

    def drawn(self, table: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, table, dims])
        return rng.normal(size=(dims + 1, self.hashes)), rng.uniform(0, self.width, self.hashes)

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        a, b = self.drawn(table, x.shape[1] - 1)
        return (x @ a + b) / self.width

    def candidates(self, x: np.ndarray) -> np.ndarray:
        unit = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1 - (unit**2).sum(axis=1)))
        return np.hstack([unit, rest[:, None]])

    def queries(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit = unit / np.sqrt((unit**2).sum(axis=1, keepdims=True))
        return np.hstack([unit, np.zeros((len(x), 1))])

    def reach(self, x: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Largest distance in cells' space of a candidate with at least that score; NaN knows nothing."""
        top = np.abs(x).max(axis=1)
        cosines = scores / top / self.longest / np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))
        far = np.sqrt(np.maximum(0.0, 2 - 2 * cosines))
        return np.clip(np.where(np.isfinite(far), far, FARTHEST), NEAREST, FARTHEST)

    def key(self, cells: np.ndarray, table: int, dims: int) -> np.ndarray:
        """Cells as one number; buckets that happen to share it are visited together."""
        out = np.full(len(cells), table * 1_000_003 + dims, np.uint64)
        for column in cells.astype(np.int64).view(np.uint64).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _share(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def probes(fraction: np.ndarray, spread: float, target: float) -> Iterator[tuple[int, ...]]:
    """Perturbations of a cell, most probable first, until their shares add up to ``target``.

    ``fraction`` is the query's place within its cell in every direction, ``spread`` the standard
    deviation of a neighbour's place around it, in cells.
    """
    reach = max(1, math.ceil(4 * spread))
    steps, costs = [], []
    for f in fraction:
        shares = sorted(
            (-math.log(max(1e-300, _share((d + 1 - f) / spread) - _share((d - f) / spread))), d)
            for d in range(-reach, reach + 1)
        )
        steps.append([d for _, d in shares])
        costs.append([c for c, _ in shares])
    heap = [(sum(c[0] for c in costs), (0,) * len(costs))]
    seen, total = {heap[0][1]}, 0.0
    while heap and total < target:
        cost, at = heapq.heappop(heap)
        total += math.exp(-cost)
        yield tuple(steps[i][j] for i, j in enumerate(at))
        for i, j in enumerate(at):
            after = at[:i] + (j + 1,) + at[i + 1 :]
            if j + 1 < len(costs[i]) and after not in seen:
                seen.add(after)
                heapq.heappush(heap, (cost - costs[i][j] + costs[i][j + 1], after))


def plan(reps: DataFrame, width: float = WIDTH) -> dict[int, Hashes]:
    """For each vector length: number and longest of its vectors set the hash functions.

    Four directions divide up to some 100,000 vectors well; beyond, their number grows with the
    logarithm, so that buckets keep their size.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = reps.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"))
    return {
        r["dims"]: Hashes(
            r["longest"], max(4, math.ceil(math.log(max(1, r["n"] / 2048)) / math.log(3.4))), width
        )
        for r in sizes.collect()
    }


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, ...]]:
    """Length, ids, vectors and other columns of the rows of each length."""
    others = [name for name in batch.schema.names if name not in ("rep", "v")]
    lengths = np.asarray(pc.list_value_length(batch.column("v")))
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        part = batch.take(pa.array(rows))
        rest = [part.column(name).to_numpy(zero_copy_only=False) for name in others]
        yield int(dims), part.column("rep").to_numpy(), matrix(part.column("v")), *rest


INDEX = "key bigint, rep bigint, v array<double>"


def _rows(keys: np.ndarray, reps: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    lists = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps), lists], ["key", "rep", "v"])


def index(reps: DataFrame, hashes: dict[int, Hashes]) -> DataFrame:
    """Every vector under its bucket of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, x in _by_length(batch):
                h = hashes[dims]
                made = h.candidates(x)
                for table in range(h.tables):
                    cells = np.floor(h.places(made, table))
                    yield _rows(h.key(cells, table, dims), ids, x)

    return reps.select("rep", "v").mapInArrow(run, INDEX)


def visits(asked: DataFrame, hashes: dict[int, Hashes], reach: float | None, target: float) -> DataFrame:
    """Every query under the buckets it visits. Without a ``reach`` it follows from the column ``least``, a
    score that the neighbours reach, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, x, least in _by_length(batch):
                h = hashes[dims]
                made = h.queries(x)
                far = np.full(len(x), reach) if reach is not None else h.reach(x, least)
                for table in range(h.tables):
                    places = h.places(made, table)
                    cells = np.floor(places)
                    for i in range(len(x)):
                        steps = np.array(list(probes(places[i] - cells[i], far[i] / h.width, target)))
                        keys = np.unique(h.key(cells[i] + steps, table, dims))
                        yield _rows(keys, np.full(len(keys), ids[i]), np.repeat(x[i : i + 1], len(keys), axis=0))

    least = F.lit(None).cast("double").alias("least") if reach is not None else "least"
    return asked.select("rep", "v", least).mapInArrow(run, INDEX)


def scan(asked: pa.Table, members: pa.Table, most: int) -> pa.Table:
    """Best ``most`` members of a chunk for each visiting query, scored exactly."""
    schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("score", pa.float64())])
    parts = []
    lengths = np.asarray(pc.list_value_length(members.column("v")))
    wanted = np.asarray(pc.list_value_length(asked.column("v")))
    for dims in np.intersect1d(lengths, wanted):
        ours = members.take(pa.array(np.flatnonzero(lengths == dims)))
        theirs = asked.take(pa.array(np.flatnonzero(wanted == dims)))
        c, x = ours.column("rep").to_numpy(), matrix(ours.column("v"))
        order = np.argsort(c, kind="stable")
        c, x = c[order], x[order]
        for at in range(0, len(theirs), 512):
            some = theirs.slice(at, 512)
            q = some.column("rep").to_numpy()
            scores = matrix(some.column("v")) @ x.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            parts.append(
                pa.table(
                    [
                        pa.array(np.repeat(q, best.shape[1])),
                        pa.array(c[best].ravel()),
                        pa.array(np.take_along_axis(scores, best, 1).ravel()),
                    ],
                    schema=schema,
                )
            )
    return pa.concat_tables(parts) if parts else schema.empty_table()


def nearest(
    vectors: DataFrame,
    k: int,
    every: int,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    width: float = WIDTH,
    reach: float = REACH,
    target: float = TARGET,
    chunk: int = CHUNK,
) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row whose id is divisible by ``every``:
    ``(query_id, rank, vec_id, score)``, ties to the smaller id, the row itself left out.

    Null and zero vectors, and such with null or non-finite components, take no part, nor do rows
    without an id. Vectors are compared with those of their own length. Copies of a vector are
    searched once (see :func:`representatives`). ``width`` and ``target`` set how much is visited, ``reach``
    how much of it in the first pass; the README has the measured recall. As many rows as there are
    candidates, up to ``k``, are found for every query.
    """
    rows = usable(vectors, id_column, vector_column).where(F.exists("v", lambda x: x != 0))
    rows = stored(rows, "vectors")
    reps = stored(representatives(rows, k + 1), "representatives")
    queries = stored(queries_of(rows, reps, every), "queries")
    hashes = plan(reps, width)
    asked = stored(reps.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v"), "asked")
    members = stored(index(reps, hashes), "buckets")

    def run(theirs: pa.Table, ours: pa.Table) -> pa.Table:
        return scan(theirs, ours, k + 1)

    def met(sent: DataFrame, members: DataFrame) -> DataFrame:
        """Best hits of the queries in the buckets that they are sent to."""
        sizes = [
            rows.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
            for rows, name in ((members, "parts"), (sent, "visitors"))
        ]
        cells = stored(sizes[0].join(sizes[1], "key"), "cells")

        def deal(rows: DataFrame, own: str, other: str) -> DataFrame:
            """Each row to one chunk of its own kind, and to all of the other's."""
            mine = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")
            across = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            return rows.join(cells, "key").select("key", mine.alias(own), across.alias(other), "rep", "v")

        left = deal(sent, "visitors", "parts").groupBy("key", "visitors", "parts")
        right = deal(members, "parts", "visitors").select(
            F.col("key").alias("of"), F.col("visitors").alias("i"), F.col("parts").alias("j"), "rep", "v"
        )
        found = left.cogroup(right.groupBy("of", "i", "j")).applyInArrow(run, "q bigint, c bigint, score double")
        return merged(found)

    def merged(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.col("score").desc(), "c")
        found = found.groupBy("q", "c").agg(F.max("score").alias("score"))
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")

    def with_hits(found: DataFrame) -> DataFrame:
        hits = found.groupBy(F.col("q").alias("rep")).agg(F.count("*").alias("hits"), F.min("score").alias("least"))
        return asked.join(hits, "rep", "left")

    first = stored(met(stored(visits(asked, hashes, reach, FIRST), "visits"), members), "hits")
    # with the query itself, k + 1 hits hold k others
    least = F.when(F.col("hits") > k, F.col("least")).alias("least")
    bounded = with_hits(first).select("rep", "v", least)
    sent = stored(visits(bounded, hashes, None, target), "visits")
    found = stored(merged(first.union(met(sent, members))), "hits")
    sizes = reps.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(k + 1), "n")
    short = with_hits(found).join(sizes, F.size("v") == F.col("dims")).where(F.coalesce("hits", F.lit(0)) < wanted)
    short = stored(short.select("rep", "v"), "short")
    if not short.isEmpty():
        whole = F.size("v").cast("bigint").alias("key")
        found = merged(found.union(met(short.select(whole, "rep", "v"), reps.select(whole, "rep", "v"))))
    return top_rows(found, reps, queries, k)
