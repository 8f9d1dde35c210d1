"""Boilerplate lines by their frequency within a site.

Pages are grouped by host. For every line of a host, the number of its pages that hold the line is
divided by the host's number of pages; lines above a ratio are boilerplate and are dropped from
the pages of that host. A host of ``p`` pages has at most ``lines per page / ratio`` such lines,
so its list of them is short however large the host is, and travels in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.05
MIN_PAGES = 3
"""A line of fewer pages than this is never boilerplate: a host of one page would lose everything, and two pages
may share a line by chance. Beyond, the ratio alone decides."""


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per run between tags; scripts and styles are left out."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}(?:[ \t\r\n/][^>]*)?>.*?</{tag}[ \t\r\n]*>", "\n")
    lines = F.regexp_replace(html, r"<[^>]*>", "\n")
    return F.regexp_replace(lines, r"[ \t\r]*\n[ \t\r\n]*", "\n")


def frequent_lines(
    pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True
) -> DataFrame:
    """``pages(host, text)`` -> ``(host, line_hash, pages, host_pages)`` of boilerplate lines.

    Lines are told apart by two hashes (96 bits together) of their text without outer spaces; blank lines do not count.
    A page counts once for a line, however often it repeats it. Without ``copies``, pages of a host
    with one text count as one page, for its lines and for the host.
    """
    pages = pages.withColumn("page", _key(F.col("text")))
    number = F.count("*") if copies else F.count_distinct("page")
    lines = pages.where("text is not null").select("host", "page", F.explode(line_keys("text")).alias("line"))
    counts = lines.groupBy("host", "line").agg(number.alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(number.alias("host_pages"))
    # the rows of a host that pass are few (see above), but before the division they are not
    return counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(
        F.col("pages") > F.lit(ratio) * F.col("host_pages")
    ).select(counts["host"], "line", "pages", "host_pages")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def line_keys(text: str) -> Column:
    """The different non-blank lines of a text, as hashes."""
    kept = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(kept, _key))


def drop_frequent(
    pages: DataFrame,
    host: str,
    text: str,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies: bool = True,
) -> DataFrame:
    """All rows and columns of ``pages``, their ``text`` without the boilerplate lines of their host.

    Adds ``_lines_removed``. Lines end with a line feed; they are compared without outer spaces, the
    lines that stay are unchanged and in order, blank ones too. Null texts stay null and count as
    pages without lines. A null host is a host of its own. A text all of whose lines go becomes empty.
    ``copies`` as in :func:`frequent_lines`; copies lose the same lines either way.
    Other columns may have any name that does not start with ``_tw_``; a ``_lines_removed`` is replaced.
    """
    pages = pages.drop("_lines_removed")
    narrow = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    lists = (
        frequent_lines(narrow, ratio, min_pages, copies)
        .groupBy("host")
        .agg(F.collect_set("line").alias("_tw_drop"))
        .withColumnRenamed("host", "_tw_host")
    )
    joined = pages.join(lists, F.col(host).eqNullSafe(F.col("_tw_host")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_tw_drop"), _key(F.trim(x))))
    hit = F.col("_tw_drop").isNotNull() & F.col(text).isNotNull()
    return joined.withColumn("_tw_kept", F.when(hit, kept)).select(
        *[
            (F.coalesce(F.array_join("_tw_kept", "\n"), F.col(text)) if name == text else F.col(name)).alias(name)
            for name in pages.columns
        ],
        F.when(hit, F.size(lines) - F.size("_tw_kept")).otherwise(0).cast("bigint").alias("_lines_removed"),
    )
