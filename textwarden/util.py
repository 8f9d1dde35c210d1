"""Intermediate results, tables that are files or folders, and the spreading of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = "spark.textwarden.tasks"
"""Setting that spreads every table of texts to so many tasks as it is read. Unset by default: a
table in several files or row groups has splits of its own, and moving its texts costs more."""


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Only a session with a local master may leave that unset; a temporary folder is then set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="textwarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textwarden-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a result to the scratch folder and read it back, so that several passes over it
    do not repeat the work before it and lost executors cannot lose it."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_share(df: DataFrame) -> float:
    """The share of a written table, by the size of its files, that the session's broadcast joins take: 1 or more
    when all of it fits, 0 when they are off."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return max(limit, 0) / max(size, 1)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a written table is, by the size of its files, small enough for the session's broadcast joins."""
    return broadcast_share(df) >= 1


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by bytes: 10,000 whole texts may be any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))  # without a default of ours, which would hide Spark's own
    if now > BATCH_BYTES or now <= 0:
        spark.conf.set(name, str(BATCH_BYTES))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in whatever store it lies."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return found.getFileSystem(conf).getFileStatus(found).isDirectory()


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Put computed columns behind a one-row generator.

    Spark moves a later filter on a column below the projection that computes it and then
    evaluates the expression in both places, again for every column it is made of. Below a
    generator it cannot look, so such filters read the finished values; filters on the other
    columns still reach the scan.
    """
    others = [name for name in df.columns if name not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal rows out to ``tasks`` tasks, or to the number the session sets; else leave them be."""
    if tasks is None:
        setting = df.sparkSession.conf.get(TASKS, None)
        tasks = int(setting) if setting else None
    return df if tasks is None else df.repartition(tasks)
