"""Ordered scans over groups of any size.

A window keyed by a group puts the whole group into one task. Here rows are range-partitioned
by (group, order), so a group that holds a third of all rows is cut into many blocks, and only
one summary row per block has to be looked at to connect neighbouring blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garner.session import cut, width

BLOCK = "__block"


def blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows tagged with the range partition they fall in; cut, as partition numbers must not move.

    The scans below take tagged rows, or any subset of them, and leave the tag on.
    """
    ranged = df.repartitionByRange(width(df.sparkSession), *keys, *order)
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _shared(rows: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """Summaries of the groups that lie in more than one block.

    Blocks are contiguous ranges, so a block shares at most its first and its last group with
    others: the result has at most two rows per block, whatever the data, and may be broadcast.
    """
    key = F.struct(*keys)
    edges = rows.groupBy(BLOCK).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    edges = edges.select(BLOCK, F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    several = edges.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    several = several.select(F.col(BLOCK).alias("__b"), *[F.col(f"key.{k}").alias(f"__s_{k}") for k in keys])
    on = rows[BLOCK] == several["__b"]
    for k in keys:
        on = on & rows[k].eqNullSafe(several[f"__s_{k}"])
    return rows.join(F.broadcast(several), on, "left_semi").groupBy(BLOCK, *keys).agg(*measures)


def _attach(rows: DataFrame, facts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` of the few (block, group) facts."""
    few = facts.select(F.col(BLOCK).alias("__b"), *[F.col(k).alias(f"__k_{k}") for k in keys], column)
    on = rows[BLOCK] == few["__b"]
    for k in keys:
        on = on & rows[k].eqNullSafe(few[f"__k_{k}"])
    return rows.join(F.broadcast(few), on, "left").drop("__b", *[f"__k_{k}" for k in keys])


def running(rows: DataFrame, keys: list[str], order: list[str], weight: Column | None = None, name: str = "position") -> DataFrame:
    """Inclusive running sum of ``weight`` (default 1: a row number) per group, in ``order``.

    ``rows`` come from ``blocks``; ``order`` must be unique within a group for a repeatable
    result. A null weight counts 0; a null group key is a group of its own.
    """
    rows = rows.withColumn("__weight", F.lit(1).cast("long") if weight is None else F.coalesce(weight, F.lit(0)))
    inner = Window.partitionBy(BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = _shared(rows, keys, [F.sum("__weight").alias("__total")])
    prior = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__offset", F.sum("__total").over(prior))
    out = _attach(rows.withColumn("__sum", F.sum("__weight").over(inner)), sums, keys, "__offset")
    return out.withColumn(name, F.col("__sum") + F.coalesce("__offset", F.lit(0))).drop("__weight", "__sum", "__offset")


def neighbour(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str, after: bool = False) -> DataFrame:
    """``columns`` of the row before (or ``after``) each row, per group and ``order``.

    ``rows`` come from ``blocks``. ``<prefix>exists`` is false on a group's first (last) row.
    Inside a block the neighbour is found by a window, across blocks as the last (first) row of
    the nearest earlier (later) block of the group.
    """
    held, place = F.struct(*columns), F.struct(*order)
    edge = F.min_by(held, place) if after else F.max_by(held, place)
    step = F.lead if after else F.lag
    edges = _shared(rows, keys, [edge.alias("__edge")])
    edges = edges.withColumn("__carry", step("__edge").over(Window.partitionBy(*keys).orderBy(BLOCK)))
    inner = Window.partitionBy(BLOCK, *keys).orderBy(*order)
    out = _attach(rows.withColumn("__near", step(held).over(inner)), edges, keys, "__carry")
    out = out.withColumn("__got", F.coalesce("__near", "__carry"))
    named = {f"{prefix}exists": F.col("__got").isNotNull()} | {f"{prefix}{c}": F.col("__got")[c] for c in columns}
    return out.withColumns(named).drop("__near", "__carry", "__got")
