"""Vector tables: which rows take part, and copies of a vector held as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, v)`` of the rows with an id and a vector of finite numbers; a row that repeats
    another's id and vector counts once."""
    infinite = F.lit(float("inf"))
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite).distinct()


def representatives(rows: DataFrame, most: int) -> DataFrame:
    """``rows(vec_id, v)`` -> one row per different vector: ``(rep, v, ids)``.

    ``ids`` are its ``most`` smallest ids, ``rep`` the smallest. A search for fewer than ``most``
    neighbours can miss nothing by this: copies have equal scores, and ties go to smaller ids.
    The rank is limited map-side, so a vector with a third of all rows is no large task.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "v", "ids"
    )


def queries_of(rows: DataFrame, reps: DataFrame, every: int) -> DataFrame:
    """``(query_id, rep)`` of the rows whose id is divisible by ``every``."""
    asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return asked.join(reps.select("rep", "v"), "v").select("query_id", "rep")


def top_rows(found: DataFrame, reps: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``found(q, c, score)`` between representatives -> ``(query_id, rank, vec_id, score)``.

    ``found`` holds, for each ``q``, its ``k + 1`` best representatives (or all)."""
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    rows = found.join(reps.select(F.col("rep").alias("c"), F.explode("ids").alias("vec_id")), "c")
    rows = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    mine = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        queries.join(rows, F.col("rep") == F.col("q"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(mine))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of number lists of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
