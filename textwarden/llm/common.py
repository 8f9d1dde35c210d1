"""What several operators share: stored intermediate results and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""A word of the contracts: a run of anything but ASCII blanks."""


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    Only a session with a local master may go without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textwarden-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Spark deletes a query's shuffle files as soon as the query has ended, not when the driver collects garbage."""

VECTORED = "parquet.hadoop.vectored.io.enabled"
"""Vectored reads of local files leave every reading thread a direct buffer as large as its largest read."""


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the batches that go to Python by bytes: 10,000 whole texts may be any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(name, str(most))).rstrip("b") or most)
    if now > most or now <= 0:
        spark.conf.set(name, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: a cut in the lineage that survives
    lost executors and is computed once however often it is read. Its shuffle files go when it is written."""
    path = shared_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).option(VECTORED, "false").parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a result of :func:`stored` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: Column) -> Column:
    """Number of words of the contracts; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def components(links: DataFrame) -> DataFrame:
    """Connected components: ``links(a, b)`` of one ordered type -> ``(node, root)``.

    ``root`` is the smallest node of the component; nodes without a link do not appear. Large-star
    and small-star steps alternate until the links stand still, which takes a number of rounds
    that grows with the logarithm of the number of nodes. A step only takes minima by node and
    joins them back, so a node with very many links is summed up map-side and its join can be
    split; no task holds all links of a node. Every round is written to the shared folder, and
    the one before it is deleted.
    """

    def write(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = stored(df, "links")
        mark = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, tuple(mark)

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))

    def large_star(df: DataFrame) -> DataFrame:
        pairs = df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            df.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        found = pairs.join(smallest(pairs), "u").where("v > u")
        return found.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(df: DataFrame) -> DataFrame:
        pairs = df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = smallest(pairs)
        moved = pairs.join(least, "u").where("v <> m")
        return (
            moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )

    current, mark = write(links.select("a", "b").where("a <> b").distinct())
    while True:
        after, new = write(small_star(large_star(current)))
        discard(current)
        if new == mark:
            break
        current, mark = after, new
    # all links now lead from a node to its root
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
