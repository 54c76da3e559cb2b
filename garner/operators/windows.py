"""Context windows, top-k and as-of picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garner.operators.segments import BLOCK, blocks, running


def context(rows: DataFrame, keys: list[str], order: list[str], target: Column, before: int, after: int) -> DataFrame:
    """Rows around each target row: up to ``before`` and ``after`` neighbours in ``order``.

    Adds target_place (the target's place in its group), offset (0 for the target itself), and
    more_before and more_after, which tell that the group goes on beyond the window. Groups may
    hold any share of the rows: places come from a segmented count, and neighbours from an
    equality join on place, not from a window over the group.
    """
    placed = running(blocks(rows.withColumn("__hit", target), keys, order), keys, order, name="__place").drop(BLOCK)
    sizes = placed.groupBy(*keys).agg(F.max("__place").alias("__size"))
    hits = placed.where("__hit").select(*keys, F.col("__place").alias("target_place"))
    hits = hits.join(sizes, keys)
    wanted = hits.select(
        *keys,
        "target_place",
        (F.col("target_place") - before > 1).alias("more_before"),
        (F.col("target_place") + after < F.col("__size")).alias("more_after"),
        F.explode(F.sequence(F.greatest(F.col("target_place") - before, F.lit(1)), F.least(F.col("target_place") + after, F.col("__size")))).alias("__place"),
    )
    return placed.join(wanted, [*keys, "__place"]).withColumn("offset", F.col("__place") - F.col("target_place")).drop("__hit", "__place")


def top_per_source(parts: list[DataFrame], order: list[Column], limit: int | None) -> DataFrame:
    """First ``limit`` rows of each source, then of their union; ``limit`` None or below 1 means all."""
    if limit is None or limit < 1:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.orderBy(*order)
    out = None
    for p in parts:
        few = p.orderBy(*order).limit(limit)
        out = few if out is None else out.unionByName(few)
    return out.orderBy(*order).limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by ``order``, picked by a mergeable aggregate instead of a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def best_by_rank(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``; for orders with mixed directions."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
