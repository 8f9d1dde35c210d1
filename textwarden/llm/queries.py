"""The registered queries of this subpackage: thin projections of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import alignment, ann, bpe, conversation_repair, lang_id, line_dedup, mixing, ngram_join, pii, simhash, suffix_dedup, token_counts, topk
from textwarden.llm.common import shared_path, stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hex16(number: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The rollup after loading all documents, deleting copies, revising counts and a repeated load."""
    rollup = token_counts.Rollup(spark, shared_path(spark, "token-counts"))
    token_counts.maintain(table(spark, folder, "documents"), rollup)
    return rollup.totals()


def op2_ann(spark: SparkSession, folder: str) -> DataFrame:
    found = ann.nearest(table(spark, folder, "embeddings"), k=20, every=20)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = topk.search(table(spark, folder, "embeddings"), k=5, every=50)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), vocabulary(), decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by the host of their URL, their visible lines without the host's boilerplate."""
    pages = table(spark, folder, "pages").select(
        "page_id",
        line_dedup.host_of(F.col("url")).alias("host"),
        line_dedup.html_lines(F.col("html")).alias("text"),
    )
    pages = stored(pages, "pages")  # the tags are taken out once
    return line_dedup.drop_frequent(pages, "host", "text").select(
        "page_id", "host", F.col("_lines_removed").alias("lines_removed"), "text"
    )


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source"
    )


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = lang_id.identify(docs.select("doc_id", "text"), lang_id.train(docs))
    out = F.coalesce(lang_id.held_out(F.col("doc_id").cast("string")), F.lit(False))
    return found.select(
        "doc_id", out.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score")
    )


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs)).select("doc_id", "_pii")

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    fixed = F.filter("_pii", lambda s: s["fixed"])

    def count(kind: str) -> Column:
        return F.size(F.filter(fixed, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(written(fixed), 256).alias("base_sha256"), written(F.col("_pii")).alias("spans")
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversation_repair.repair(conversation_repair.damage(turns), turns)


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return alignment.align(table(spark, folder, "documents"), a, b).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_ann": op2_ann,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_topk": op4_topk,
        "op5_bpe": op5_bpe,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_language_id": op8_language_id,
        "op9_simhash": op9_simhash,
        "op10_pii": op10_pii,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_ngram_join": op12_ngram_join,
        "op13_alignment": op13_alignment,
    }


# One line per run between tags, as the operator cuts it; the regular expressions are the same.
LINE_DEDUP = r"""
WITH raw AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') AS host,
    regexp_replace(regexp_replace(html, '<script(?:[ \t\r\n/][^>]*)?>.*?</script[ \t\r\n]*>', chr(10), 'gis'),
      '<style(?:[ \t\r\n/][^>]*)?>.*?</style[ \t\r\n]*>', chr(10), 'gis') AS html
  FROM pages),
cut AS (
  SELECT page_id, host,
    regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g') AS text
  FROM raw),
seen AS (
  SELECT DISTINCT page_id, host, trim(line, ' ') AS line
  FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line FROM cut) WHERE trim(line, ' ') <> ''),
totals AS (SELECT host, count(*) AS host_pages FROM cut GROUP BY host),
boiler AS (
  SELECT s.host, s.line FROM seen s JOIN totals t ON s.host IS NOT DISTINCT FROM t.host
  GROUP BY s.host, s.line, t.host_pages HAVING count(*) >= 3 AND count(*) > 0.05 * t.host_pages),
lists AS (SELECT host, list(line) AS lines FROM boiler GROUP BY host)
SELECT c.page_id, c.host,
  coalesce(len(list_filter(string_split(c.text, chr(10)), lambda x: list_contains(l.lines, trim(x, ' ')))), 0) AS lines_removed,
  CASE WHEN l.lines IS NULL THEN c.text ELSE array_to_string(
    list_filter(string_split(c.text, chr(10)), lambda x: NOT list_contains(l.lines, trim(x, ' '))), chr(10)) END AS text
FROM cut c LEFT JOIN lists l ON c.host IS NOT DISTINCT FROM l.host
"""


# Words do not cross lines, so a text without its repeated lines has the words of its different lines.
TOKEN_COUNTS = r"""
WITH kept AS (
  SELECT text, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text),
lines AS (
  SELECT source, lang, list_distinct(string_split(coalesce(text, ''), chr(10))) AS lines FROM kept),
measured AS (
  SELECT source, lang,
    list_sum(list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) AS words,
    list_sum(list_transform(lines, lambda x:
      len(regexp_extract_all(x, '[\p{L}\p{M}]+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]')))) AS pieces
  FROM lines)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, sum(words)::BIGINT AS tokens FROM measured GROUP BY 1, 2
UNION ALL
SELECT source, lang, 'pieces-1' AS tokenizer, count(*) AS docs, sum(pieces)::BIGINT AS tokens FROM measured GROUP BY 1, 2
"""

TOPK = """
WITH q AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_token_counts": TOKEN_COUNTS, "op4_topk": TOPK, "op6_line_dedup": LINE_DEDUP}
