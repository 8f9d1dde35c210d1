"""From raw documents to token ids: the stages, in order, and a function that runs them all.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; the result
is written to the shared folder as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import bpe, lang_id, line_dedup, mixing, simhash
from textwarden.llm.common import stored
from textwarden.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: texts that are null or have no letter.

    If no language can be learned (no document that is not held out has a ``lang``), nothing is told
    apart and no other document is dropped.
    """
    docs = docs.select(*COLUMNS)
    model = lang_id.train(docs)
    if not model.families:
        return lang_id.with_letters(docs)
    found = lang_id.identify(docs, model)
    return found.where(F.col("_lang_pred") != lang_id.UNDETERMINED).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that are frequent within their source, among its different texts: copies of a text
    are left to the next stage and do not make its lines boilerplate. No document is dropped."""
    cleaned = line_dedup.drop_frequent(docs.select(*COLUMNS), "source", "text", copies=False)
    changed = F.when(F.col("_lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed.cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates: candidates by
    fingerprint, checked for a similarity of 0.8 of their five-word shingles."""
    return simhash.keep_first(docs.select(*COLUMNS), words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix of sources takes it."""
    return mixing.take_mix(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; ``decoded_sha256`` tells what they decode to."""
    return bpe.encode(docs, vocabulary(), decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_tokens),
]

ORACLE_SQL = None
"""SQL can express neither the trained machines nor the tokenizer; a test holds ``run`` against a
brute-force version instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
