"""Token counts as rollups that are maintained by deltas.

Changes are signed: an insert counts +1, a delete -1, a revised count is its old value with -1 and
its new one with +1. A batch of changes is summed up by source, language and tokenizer version and
committed under an id. Totals are the sum of all committed batches, so they are additive
and no batch reads another. Committing an id a second time changes nothing.

A commit writes the batch's sums beside the rollup and renames them into place, which either
happens as a whole or fails because the id is there. Runs that are lost on the way leave files that
nobody reads, and can be repeated.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import WORD, stored

TOKENIZERS = {
    "words-1": WORD,
    "pieces-1": r"[\p{L}\p{M}]+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]",
}
"""Versions by name: every match of the expression is a token."""

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def counts(text: Column, tokenizers: dict[str, str] = TOKENIZERS) -> Column:
    """Tokens of a text by tokenizer version, an array of structs; a null text has none."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("tokenizer"),
                F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint").alias("tokens"),
            )
            for name, pattern in tokenizers.items()
        ]
    )


def signed(rows: DataFrame, sign: int, column: str = "counts") -> DataFrame:
    """``rows(source, lang, counts)`` as changes ``(source, lang, tokenizer, docs, tokens)``."""
    return rows.select("source", "lang", F.inline(column)).select(
        "source", "lang", "tokenizer", F.lit(sign).cast("bigint").alias("docs"), (sign * F.col("tokens")).alias("tokens")
    )


def inserted(rows: DataFrame, column: str = "counts") -> DataFrame:
    return signed(rows, 1, column)


def deleted(rows: DataFrame, column: str = "counts") -> DataFrame:
    return signed(rows, -1, column)


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Changes of rows whose counts were ``old`` and are ``new``."""
    return signed(rows, -1, old).union(signed(rows, 1, new))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share. One writer at a time per batch id wins."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._path = fs.Path
        self._context = fs.FileContext.getFileContext(fs.Path(self.path).toUri(), self._conf)
        self._options = getattr(fs, "Options$Rename")

    def _exists(self, path: str) -> bool:
        return self._context.util().exists(self._path(path))

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        folder = f"{self.path}/batches"
        if not self._exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._context.util().listStatus(self._path(folder)))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, without reading ``changes``, if the id has been committed before.

        Null sources and languages are keys of their own. Sums that come out as zero are kept.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        target = f"{self.path}/batches/{batch}"
        if self._exists(target):
            return False
        staged = f"{self.path}/staged/{batch}-{uuid.uuid4().hex}"
        summed(changes).select(*[n.split()[0] for n in SCHEMA.split(", ")]).write.parquet(staged)
        fs = self.spark._jvm.org.apache.hadoop.fs
        self._context.mkdir(self._path(f"{self.path}/batches"), fs.permission.FsPermission.getDirDefault(), True)
        none = self.spark.sparkContext._gateway.new_array(self._options, 0)
        try:
            self._context.rename(self._path(staged), self._path(target), none)
        except Exception:
            if self._exists(target):  # another writer was first
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches; keys whose
        documents and tokens have all gone are left out."""
        folders = [f"{self.path}/batches/{name}" for name in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA).parquet(*folders)
        return summed(found).where((F.col("docs") != 0) | (F.col("tokens") != 0))


def without_repeated_lines(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def maintain(docs: DataFrame, rollup: Rollup, tokenizers: dict[str, str] = TOKENIZERS) -> list[bool]:
    """Keep the rollup of a corpus through its life: all documents are loaded, exact copies are
    deleted, texts lose their repeated lines, and a load that is sent twice does not count.

    ``docs(doc_id, text, source, lang, ...)``. Of equal texts the one with the smallest ``doc_id``
    stays (null ids last, then by source and language; of repeated rows one). Null texts count as
    documents without tokens, and as copies of each other. Returns which commits took effect.
    """
    measured = stored(
        docs.select(
            "doc_id",
            F.col("source").cast("string"),
            F.col("lang").cast("string"),
            F.sha2(F.col("text"), 256).alias("text_key"),
            counts(F.col("text"), tokenizers).alias("counts"),
            counts(without_repeated_lines(F.col("text")), tokenizers).alias("revised"),
        ),
        "measured",
    )
    name = ["doc_id is null", "doc_id", "source is null", "source", "lang is null", "lang"]
    order = F.struct(*[F.expr(x).alias(f"o{i}") for i, x in enumerate(name)])
    first = measured.groupBy("text_key").agg(
        F.min(order).alias("first"),
        F.first("counts").alias("counts"),
        F.first("revised").alias("revised"),
    ).select(F.col("first.o3").alias("source"), F.col("first.o5").alias("lang"), "counts", "revised")
    # the copies are all documents less the first ones
    copies = deleted(measured).union(inserted(first))
    changed = first.where(F.col("counts") != F.col("revised"))
    return [
        rollup.commit("load", inserted(measured)),
        rollup.commit("copies", copies),
        rollup.commit("lines", revised(changed, "counts", "revised")),
        rollup.commit("load", inserted(measured)),
    ]
