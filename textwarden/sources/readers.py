"""Where texts come from: CSV uploads, JSON requests, tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden import config
from textwarden.util import settle, spread

SINGLE_REQUEST = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("thresholds", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
BATCH_REQUEST = T.StructType(
    [
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("thresholds", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
LABELLED_ROW = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("expected", T.IntegerType()),
        T.StructField("category", T.StringType()),
    ]
)
CORRUPT = "_corrupt_record"


def files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The CSV files of a path, grouped by their header line.

    A file's first line is found by the task that reads its beginning; one line per file is kept.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    heads = lines.where("at = 0").groupBy("file").agg(F.first("value").alias("header"))
    groups = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [row["files"] for row in groups.orderBy("header").collect()]


LATTICE = ("bigint", "double", "boolean", "date", "timestamp")
"""Types a column of cells may have, each tried before the next; string takes all."""


def infer_types(cells: DataFrame) -> dict[str, str]:
    """The narrowest common type of every column of strings, over all rows in one pass.

    Each task counts the cells a type cannot hold, and the counts are added up, so files that disagree meet
    in the type that holds both: whole numbers and fractions in ``double``, dates and times in ``timestamp``,
    anything else in ``string``. Empty columns stay strings. Numbers with leading zeros are numbers.
    """
    names = [name for name in cells.columns if name != CORRUPT]
    if not names:
        return {}
    columns = []
    for i, name in enumerate(names):
        cell = F.col(f"`{name}`")
        columns.append(F.count(cell).alias(f"n{i}"))
        for j, kind in enumerate(LATTICE):
            # a number is no boolean, date or time, though Spark would read a year
            fits = cell.try_cast(kind).isNotNull()
            fits = fits & ~cell.rlike(r"^\s*[+-]?\d+\s*$") if kind in LATTICE[2:] else fits
            # and a date has no time of day, though Spark would cut it off
            fits = fits & cell.rlike(r"^\s*\d{4,}-\d{1,2}-\d{1,2}\s*$") if kind == "date" else fits
            columns.append(F.count_if(cell.isNotNull() & ~fits).alias(f"n{i}_{j}"))
    found = cells.agg(*columns).first()
    types = {}
    for i, name in enumerate(names):
        fitting = [kind for j, kind in enumerate(LATTICE) if found[f"n{i}"] and not found[f"n{i}_{j}"]]
        types[name] = fitting[0] if fitting else "string"
    return types


def typed_columns(cells: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Columns of strings as their inferred types (or those given); reads the rows twice."""
    types = infer_types(cells) if types is None else types
    return cells.select(
        *[F.col(f"`{c}`").cast(types[c]).alias(c) if types.get(c, "string") != "string" else F.col(f"`{c}`") for c in cells.columns]
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read CSV files with a header, all columns as strings (:func:`typed_columns` infers others).

    Files may differ in the order and number of their columns: those with one header are read
    together under it, and the groups are put together by column name. Rows that do not fit their
    header keep their raw form in ``_corrupt_record``. Quoted line breaks need ``multi_line``, which
    makes every file one task; without it Spark splits large files. Header names hold no line breaks.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}

    def read(files: list[str]) -> DataFrame:
        names = spark.read.options(**options).csv(files[0]).columns
        schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, CORRUPT]])
        reader = spark.read.schema(schema).options(
            **options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
        )
        return reader.csv(files)

    parts = [read(files) for files in files_by_header(spark, path)]
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(CORRUPT, T.StringType())]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def find_text_column(columns: Sequence[str]) -> str:
    """First column, in file order, whose lower-cased name is a known text column name."""
    for name in columns:
        if name.lower() in config.TEXT_COLUMNS:
            return name
    raise ValueError(
        f"no text column among {list(columns)}; rename one to one of {', '.join(config.TEXT_COLUMNS)}"
    )


def text_column(
    df: DataFrame, out: str = "text", null_markers: Sequence[str] = ()
) -> DataFrame:
    """Find the text column, drop its missing values and give it out as strings.

    Pass ``config.CSV_NULL_MARKERS`` to take the cells pandas would call missing as missing.
    """
    name = find_text_column(df.columns)
    cells = df.where(F.col(name).isNotNull())
    if null_markers:
        cells = cells.where(~F.col(name).cast("string").isin(list(null_markers)))
    others = [column for column in df.columns if column not in (name, out)]
    return cells.select(*others, F.col(name).cast("string").alias(out))


def read_csv_texts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Texts of uploaded CSV files, ready to moderate."""
    return text_column(read_csv(spark, path, multi_line), null_markers=config.CSV_NULL_MARKERS)


def read_requests(spark: SparkSession, path: str, batch: bool = False) -> DataFrame:
    """JSON request bodies, one per line; a broken body keeps its raw form."""
    schema = BATCH_REQUEST if batch else SINGLE_REQUEST
    fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(fields).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def parse_requests(df: DataFrame, body: str, batch: bool = False) -> DataFrame:
    """Replace a column of JSON request bodies by the fields of the request."""
    schema = BATCH_REQUEST if batch else SINGLE_REQUEST
    others = [name for name in df.columns if name != body]
    fields = df.withColumn("_request", F.from_json(body, schema)).select(*others, "_request.*")
    return settle(fields, *schema.names)


def labelled_rows(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A small labelled set written inline."""
    return spark.createDataFrame(list(rows), LABELLED_ROW)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table whose rows cost real work each: spread if the session asks for it."""
    return spread(read_table(spark, folder, name))
