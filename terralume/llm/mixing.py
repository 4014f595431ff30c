"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document of a source is expected the same number of copies, its source's target over its
source's size. The expected copies are added up along the source, one random offset per source is
added, and a document is emitted once for every whole number that its step crosses. Documents lie
in order of size, so that every size is taken in proportion; the order is found by counting cells
(size class, hash bucket) first, so no source is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralume.session import materialize

from .common import free_name, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKETS = 1024  # hash buckets of a size class
CLASSES = 64  # size classes of a doubling of size; sizes below 64 have their own


def size_class(size: Column) -> Column:
    return F.when(size < CLASSES, size).otherwise(F.floor(F.log2(size.cast("double")) * CLASSES)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` for a table of a row per source.

    Sources in order of code points, null last, get the weights in turn. A target stops at ``most``
    times its source's size; the excess goes to the others by weight. In the end one level of
    size per weight holds for all that aren't full.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    known = sizes.withColumn("_w", weight).withColumn("_cap", (most * F.col("source_size")).cast("double"))
    known = known.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    below = Window.orderBy("_ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    upto = known.withColumn("_caps", F.sum("_cap").over(below)).withColumn("_ws", F.sum("_w").over(below))
    upto = upto.withColumn("_total", F.sum("source_size").over(everything).cast("double")).withColumn("_all", F.sum("_w").over(everything))
    # Give every source the level of this ratio: full ones take their caps, the rest by weight. This
    # source is full if all that together needs no more than there is.
    needed = F.col("_caps") + (F.col("_all") - F.col("_ws")) * F.col("_ratio")
    marked = upto.withColumn("_full", needed <= F.col("_total"))
    caps = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))
    ws = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - caps) * F.col("_w") / ws)
    return marked.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``; new names get underscores where they clash.

    The size is the number of words; a null text has none, and a source without words has target 0
    and no copies. A null source is a source of its own. Rows count one by one, repeated rows and
    null keys as any others. No document has more than ``most`` copies, and a run with the same
    rows and seed gives the same copies. An empty table stays empty.
    """
    names = {n: free_name(docs.columns, n) for n in ("size", "source_size", "target", "copies")}
    # Own columns get a prefix that no column of ``docs`` has.
    p = free_name([c[: len("mix_")] for c in docs.columns], "mix_")
    order = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.withColumns({f"{p}source": F.col(f"`{source}`"), f"{p}size": word_count(F.col(f"`{text}`")), f"{p}order": order})
    rows = rows.withColumns({
        f"{p}class": size_class(F.col(f"{p}size")),
        f"{p}bucket": F.pmod(F.shiftright(f"{p}order", 20), F.lit(BUCKETS)).cast("int"),
    })

    cells = rows.groupBy(F.col(f"{p}source").alias("source"), F.col(f"{p}class").alias("class"), F.col(f"{p}bucket").alias("bucket"))
    # Written once: at most BUCKETS rows for each size class of a source, read by every sum below.
    cells = materialize(cells.agg(F.count("*").alias("n"), F.sum(f"{p}size").alias("size")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # Two prefix sums: buckets within a class, classes within a source.
    earlier = Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = cells.select("source", "class", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inner"))
    by_class = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    smaller = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    outer = by_class.select("source", "class", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("outer")).alias("o")
    outer = outer.join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
    outer = outer.select("o.source", "class", "outer", "source_size", "target").alias("o")
    base = inner.alias("i").join(outer, F.col("i.source").eqNullSafe(F.col("o.source")) & (F.col("i.class") == F.col("o.class")))
    base = base.select(
        F.col("i.source").alias(f"{p}of"), F.col("i.class").alias(f"{p}in"), F.col("bucket").alias(f"{p}cell"),
        (F.col("inner") + F.col("outer")).alias(f"{p}base"), F.col("source_size").alias(f"{p}all"), F.col("target").alias(f"{p}target"),
    )

    within = Window.partitionBy(f"{p}source", f"{p}class", f"{p}bucket").orderBy(f"{p}size", f"{p}order")
    ranked = rows.withColumn(f"{p}rank", F.row_number().over(within) - 1)
    found = ranked.join(
        base,
        F.col(f"{p}source").eqNullSafe(F.col(f"{p}of")) & (F.col(f"{p}class") == F.col(f"{p}in")) & (F.col(f"{p}bucket") == F.col(f"{p}cell")),
    )
    each = F.when(F.col(f"{p}all") > 0, F.col(f"{p}target") / F.col(f"{p}all")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(f"{p}source"), F.lit("\0null"))), F.lit(1024)) / F.lit(1024.0)
    at = F.col(f"{p}base") + F.col(f"{p}rank")
    copies = F.floor((at + 1) * each + offset) - F.floor(at * each + offset)
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(f"{p}size").alias(names["size"]),
        F.col(f"{p}all").alias(names["source_size"]),
        F.col(f"{p}target").alias(names["target"]),
        F.least(copies, F.lit(most)).cast("long").alias(names["copies"]),
    )


def sampled(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies."""
    rows = mixed(docs, text, source, weights, most, seed)
    copies = rows.columns[-1]
    repeat = free_name(rows.columns, "repeat")
    return rows.where(F.col(copies) > 0).withColumn(repeat, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
