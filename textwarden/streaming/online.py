"""Moderation of streams: the batch transform on a streaming DataFrame, plus its history."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textwarden.operators.moderation import moderate
from textwarden.util import is_folder


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream files as they arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, **options: int) -> DataFrame:
    """Stream a Parquet table, be it one file or a folder of part files."""
    if is_folder(spark, path):
        return read_stream(spark, path, schema, **options)
    folder, _, name = path.rpartition("/")
    return read_stream(spark, folder, schema, name, **options)


def moderate_stream(
    stream: DataFrame, text: str = "text", tasks: int | None = None, **options: object
) -> DataFrame:
    """Moderate a stream. Stateless: weights and thresholds are part of the expressions.

    ``tasks`` spreads every batch, for sources that deliver few large files.
    """
    if not stream.isStreaming:
        raise ValueError("moderate_stream takes a streaming DataFrame; use moderate for tables")
    stream = stream if tasks is None else stream.repartition(tasks)
    return moderate(stream, text, **options)


def append_history(
    moderated: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append verdict rows to a Parquet history; each row is written exactly once."""
    writer = moderated.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def once_per_request(
    stream: DataFrame, request_id: str, time: str, delay: str = "1 hour"
) -> DataFrame:
    """Drop repeated deliveries of a request that arrive within ``delay``.

    State holds the ids of that span only.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([request_id])


def verdict_rate(
    moderated: DataFrame, time: str, width: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Texts and flagged texts per time window, final once the watermark has passed it."""
    return (
        moderated.withWatermark(time, delay)
        .groupBy(F.window(time, width))
        .agg(
            F.count("*").alias("total_texts"),
            F.count_if(F.col("verdict") == "toxic").alias("flagged_count"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            "total_texts",
            "flagged_count",
            F.try_divide("flagged_count", "total_texts").alias("flagged_share"),
        )
    )


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    partition_by: Sequence[str] = (),
    available_now: bool = False,
) -> StreamingQuery:
    """Write every micro-batch, through a batch transform, into a folder of its own: ``batch=<id>``.

    The transform sees a table, so it may join, aggregate and use learned weights as on any table; nothing is
    kept as streaming state. ``partition_by`` splits each batch's rows into folders, e.g. by verdict. A
    batch that is delivered again replaces its folder, so a replay changes nothing. Readers find
    ``batch`` and the partition columns in the folders' names (:func:`read_batches`).
    """
    run = batch_writer(path, transform, partition_by)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def batch_writer(
    path: str, transform: Callable[[DataFrame], DataFrame] | None = None, partition_by: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """What :func:`write_batches` does with each batch and its id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else transform(batch)
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={batch_id}")

    return run


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of :func:`write_batches`, with the ``batch`` that wrote them."""
    fields = [field for field in schema.fields if field.name != "batch"]
    return spark.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType())])).parquet(path)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_history(
    stream: DataFrame,
    session: str,
    order: str,
    payload: str,
    keep: int = 20,
    expire_ms: int | None = None,
) -> DataFrame:
    """The newest ``keep`` rows of every session as keyed state: ``session, rank, order, payload``.

    A session's rows come out again, newest first, whenever a batch adds to it (update mode). ``order`` is a
    long, rows without one are the oldest; ties go to the greater payload, rows that repeat one another count
    each. State holds at most ``keep`` rows of a session, which expire ``expire_ms`` after the session's last
    batch. A batch's rows of one session are read in pieces and never held together. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which this sets for the session.
    """
    from pyspark.sql.streaming import StatefulProcessor

    payload_type = dict(stream.dtypes)[payload]
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    state = T.StructType(
        [T.StructField("position", T.LongType()), T.StructField("payload", stream.schema[payload].dataType)]
    )

    # a local class, so that it is sent to the workers whole
    class Newest(StatefulProcessor):
        def init(self, handle) -> None:
            self.rows = handle.getListState("newest", state, expire_ms)

        def handleInputRows(self, key, rows, timerValues):
            place = lambda row: (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")
            newest = [tuple(row) for row in self.rows.get()] if self.rows.exists() else []
            for part in rows:
                given = part["position"].astype(object).where(part["position"].notna(), None)
                texts = part["payload"].astype(object).where(part["payload"].notna(), None)
                found = newest + [(None if o is None else int(o), p) for o, p in zip(given, texts)]
                newest = sorted(found, key=place, reverse=True)[:keep]
            self.rows.put(newest)
            n = len(newest)
            yield pd.DataFrame(
                {
                    "session_key": pd.Series([key[0]] * n, dtype=object), "rank": pd.Series(range(1, n + 1), dtype="int32"),
                    order: pd.array([row[0] for row in newest], dtype="Int64"),
                    payload: pd.Series([row[1] for row in newest], dtype=object),
                }
            )

        def close(self) -> None:
            pass

    # the session as JSON, which has no nulls: groups in Python are told apart by their values. Spark passes rows on
    # as named tuples, so column names must not begin with an underscore
    written = F.to_json(F.struct(session)).alias("session_key")
    given = stream.select(written, F.col(order).cast("bigint").alias("position"), F.col(payload).alias("payload"))
    schema = f"session_key string, rank int, {order} bigint, {payload} {payload_type}"
    time_mode = "None" if expire_ms is None else "ProcessingTime"
    found = given.groupBy("session_key").transformWithStateInPandas(Newest(), schema, "Update", time_mode)
    read = F.from_json("session_key", T.StructType([stream.schema[session]]))[session].alias(session)
    return found.select(read, "rank", order, payload)


def latest_history(batches: DataFrame, session: str) -> DataFrame:
    """Of the rows that :func:`session_history` wrote in batches, those of each session's last batch."""
    last = batches.groupBy(F.col(session).alias("_session")).agg(F.max("batch").alias("_last"))
    same = F.col(session).eqNullSafe(F.col("_session")) & (F.col("batch") == F.col("_last"))
    return batches.join(last, same).drop("_session", "_last")
