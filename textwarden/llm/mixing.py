"""Mixing sources to target weights by pivotal rounding, with built-in functions only.

Every document of a source is wanted ``target / source_size`` times, a whole number of copies plus
a fraction. Pivotal rounding settles the fractions: two documents compare their fractions, words
move at random from one to the other until one fraction is 0 or 1, and the other document goes on
with what is left. The sum of words (fraction times size) stays the same at every step, and every
document's expected fraction too, so a source misses its target by part of one document at most.

The rounding runs as a reduction tree. Documents of a source are dealt into groups of about
``GROUP`` by a hash; a group is folded in one pass, large documents first, and leaves one unsettled document,
most likely a small one, which goes up to the next level. The number of levels follows from the largest source. Chance comes
from hashes of the documents that meet, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import count_words, stored

WEIGHTS = (5, 2, 1)
MOST = 3
GROUP = 128
SEED = 20_24

ITEM = "struct<o:bigint,key:bigint,doc_id:bigint,size:bigint,p:double>"
DONE = "array<struct<key:bigint,doc_id:bigint,size:bigint,up:int>>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, n, source_size)`` -> the same plus ``target``: words wanted of each source.

    One row per source comes in. Sources by code point, null last, weigh ``weights`` in turn and
    share the sum of all sizes. A target stops at ``most`` times its source's size and the excess
    is shared again by weight: targets are ``min(cap, level * weight)``, with the one level at
    which they add up. In order of ``cap / weight`` it is the first level that is not above the
    next such ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))[(F.row_number().over(order) - 1) % len(weights)]
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_w", turn.cast("double"))
        .withColumn("_cap", (F.lit(most) * F.col("source_size")).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy(F.lit(0))))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_w").over(after))
        .withColumn("_fits", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
        .withColumn("_water", F.first("_fits", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    level = F.coalesce(F.col("_water") * F.col("_w"), F.col("_cap"))
    return ranked.select("source", "n", "source_size", F.least("_cap", level).alias("target"))


def _chance(*parts: Column) -> Column:
    """Even in [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def _meet(acc: Column, new: Column) -> Column:
    """One pivotal step: ``acc.now`` meets ``new``; one is settled, the other goes on.

    Words move so that ``p * size`` of both keeps its sum. Up to ``give`` words can move from the
    old to the new, up to ``take`` back; each direction's chance is the other's share, which keeps
    both expectations.
    """
    now = acc["now"]
    give = F.least(now["p"] * now["size"], (1 - new["p"]) * new["size"])
    take = F.least(new["p"] * new["size"], (1 - now["p"]) * now["size"])
    forth = _chance(now["key"], new["key"], now["doc_id"], new["doc_id"]) * (give + take) < take
    moved = F.when(forth, give).otherwise(-take)
    # which of the two has become whole is decided by the same comparison that bounded the move
    old_whole = F.when(
        forth, now["p"] * now["size"] <= (1 - new["p"]) * new["size"]
    ).otherwise((1 - now["p"]) * now["size"] <= new["p"] * new["size"])
    old_up = F.when(forth, 0).otherwise(1)
    new_up = F.when(forth, 1).otherwise(0)

    def settled(item: Column, up: Column) -> Column:
        return F.array(
            F.struct(item["key"].alias("key"), item["doc_id"].alias("doc_id"), item["size"].alias("size"), up.alias("up"))
        )

    def goes_on(item: Column, change: Column) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), item["p"] + change / item["size"]))
        names = ("o", "key", "doc_id", "size")
        return F.struct(*[item[name].alias(name) for name in names], p.alias("p"))

    return F.struct(
        F.when(old_whole, goes_on(new, moved)).otherwise(goes_on(now, -moved)).alias("now"),
        F.concat(
            acc["done"],
            F.when(old_whole, settled(now, old_up)).otherwise(settled(new, new_up)),
        ).alias("done"),
    )


def _fold(items: Column) -> Column:
    """Fold a group: the settled documents and the one that is left."""
    start = F.struct(items[0].cast(ITEM).alias("now"), F.array().cast(DONE).alias("done"))
    step = lambda acc, new: _meet(acc, new).cast(f"struct<now:{ITEM},done:{DONE}>")
    return F.aggregate(F.slice(items, 2, F.size(items)), start, step)


def round_fractions(items: DataFrame, group: int = GROUP) -> DataFrame:
    """``items(source, n, key, doc_id, size, p)`` -> ``(source, key, doc_id, size, up)``.

    ``p`` is strictly between 0 and 1, ``size`` positive, ``n`` the source's number of rows.
    """
    most = items.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), group)))
    done = []
    item = F.struct((-F.col("size")).alias("o"), "key", "doc_id", "size", "p")
    for level in range(levels):
        slots = F.ceil(F.col("n") / F.lit(float(group) ** (level + 1))).cast("bigint")
        # one hash for all levels, cut into ever fewer slots: what meets is spread evenly
        slot = F.pmod(F.xxhash64("key", "doc_id"), F.when(slots > 1, slots).otherwise(F.lit(1)))
        folded = (
            items.groupBy("source", "n", slot.alias("slot"))
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
            .select("source", "n", _fold(F.col("items")).alias("f"))
        )
        folded = stored(folded.select("source", "n", "f.now", "f.done"), "rounding")
        done.append(folded.select("source", F.inline("done")))
        items = folded.select("source", "n", "now.key", "now.doc_id", "now.size", "now.p")
    up = (_chance(F.col("key"), F.col("doc_id")) < F.col("p")).cast("int").alias("up")
    last = items.select("source", "key", "doc_id", "size", up)
    for part in done:
        last = last.union(part)
    return last


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, group: int = GROUP) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> one row per input row: ``(doc_id, source, key, size,
    source_size, target, copies, taken)``.

    ``size`` counts words (null text: 0), ``copies`` is how often the mix takes the document, at
    most ``most`` times, ``taken`` its words in the mix. Documents without words are taken 0 times.
    ``key`` is a hash of the row's id, source and text. A null source is a source of its own.
    Repeated rows are rounded one by one like any others; rows without ``doc_id`` too.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64("doc_id", "source", "text").alias("key"),
            count_words(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(
        F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n"), F.sum("size").alias("source_size")
    )
    wanted = stored(targets(sizes, weights, most), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate + 1e-9), F.lit(most)).cast("bigint")
    rated = rows.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "key", "size", "source_size", "target", "n",
        F.when(F.col("size") > 0, whole).otherwise(0).alias("whole"),
        F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0).alias("p"),
    )
    open_ = F.col("p") > 0
    rounded = round_fractions(rated.where(open_).select("source", "n", "key", "doc_id", "size", "p"), group)
    # what holds for a whole source is joined again, the tree carries only what it needs
    of_source = wanted.select("_source", "source_size", "target", whole.alias("whole"))
    settled = rounded.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "copies", F.col("whole") + F.col("up")
    )
    plain = rated.where(~open_).withColumn("copies", F.col("whole"))
    names = ["doc_id", "source", "key", "size", "source_size", "target", "copies"]
    return settled.select(names).union(plain.select(names)).withColumn("taken", F.col("copies") * F.col("size"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents, all columns: every document as many times as the mix takes it.

    Documents without words are not in the mix. Other columns may have any name that does not start
    with ``_tw_``. Of rows that repeat id, source and text any one stands for all of them.
    """
    # the same keys for both, and none that may be null: the texts are shuffled once
    same = ["_tw_id", "_tw_none", "_tw_key"]
    doc_id = F.col("doc_id").cast("bigint")
    of_id = {"_tw_id": F.coalesce(doc_id, F.lit(0).cast("bigint")), "_tw_none": doc_id.isNull()}
    copies = (
        mix(docs, weights, most)
        .where("copies > 0")
        .withColumns({**of_id, "_tw_key": F.col("key")})
        .groupBy(*same)
        .agg(F.sum("copies").alias("_tw_copies"))
    )
    names = docs.columns
    keyed = docs.withColumns({**of_id, "_tw_key": F.xxhash64("doc_id", "source", "text")})
    joined = keyed.dropDuplicates(same).join(copies, same)
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_tw_copies")))
    return joined.select(*names, times.alias("_tw_time")).drop("_tw_time")
