"""Sources mixed to target shares along a curriculum.

Every source has a weight that changes over training time t from 0 to 1 and whose integral is its
target share. The integral times the total is the source's token demand by time t; inverting it at
the running token sum of the source's documents, epoch after epoch, gives each document its time,
and sorting by time gives the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garner.operators.segments import blocks, running
from garner.session import cut

SEED = 11
#: How far the mixture starts from the targets towards an even one; its mean over time is the targets.
FLATNESS = 0.5


def demands(documents: DataFrame, targets: DataFrame, total: int | None = None, flatness: float = FLATNESS) -> DataFrame:
    """Demand and weight schedule per source; one row per source of ``targets``.

    ``documents``: doc_id, source, tokens; ``targets``: source, target_share, max_repeats. Without
    ``total`` the mixture is as large as the caps allow with every share met; with it, a source
    whose cap is smaller than its demand gives what it has. Sources without documents, and shares
    or caps that are null or not positive, demand nothing.
    """
    held = documents.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = targets.join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    rows = rows.withColumn("cap", F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
    open_ = (F.col("target_share") > 0) & (F.col("cap") > 0)
    rows = rows.withColumn("share", F.when(open_, F.col("target_share")).otherwise(0.0))
    even = F.try_divide(F.sum("share"), F.count(F.when(open_, 1)))
    sums = rows.agg(F.min(F.when(open_, F.try_divide("cap", "share"))).alias("most"), even.alias("even")).first()
    most, even = sums["most"] or 0.0, sums["even"] or 0.0
    rows = rows.withColumn("total", F.lit(float(total or most)))
    rows = rows.withColumn("demand", F.least(F.col("share") * F.col("total"), F.col("cap").cast("double")))
    # start = (1 - f) * w + f / k and end = (1 + f) * w - f / k, in shares of the k open sources
    limit = rows.agg(F.min(F.when(open_ & (F.col("share") < even), F.try_divide(F.col("share"), F.lit(even) - F.col("share"))))).first()[0]
    f = min(flatness, limit if limit is not None else flatness)
    start = F.when(open_, F.try_divide(F.lit(1 - f) * F.col("share") + F.lit(f * even), F.col("share"))).otherwise(1.0)
    return rows.withColumn("start", start).select("source", "target_share", "max_repeats", "available", "demand", "total", "start")


def mixture(documents: DataFrame, demand: DataFrame, seed: int = SEED) -> DataFrame:
    """Drawn documents in training order: position, source, doc_id, epoch, tokens, at.

    Each epoch runs through a source in an order of its own. The demand up to time t is
    demand * (start * t + (1 - start) * t^2), whose inverse at the middle of a document is its
    time ``at``; a document is drawn if its middle lies within the demand. Documents without
    tokens, and sources without demand, are left out.
    """
    rows = documents.where("tokens > 0 and doc_id is not null").join(demand.where("demand > 0"), "source")
    epochs = F.ceil(F.col("demand") / F.col("available")).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs)))
    rows = rows.withColumn("shuffle", F.xxhash64(F.lit(seed), "epoch", "doc_id"))
    lean = rows.select("source", "epoch", "shuffle", "doc_id", "tokens", "available", "demand", "start")
    summed = running(blocks(lean, ["source", "epoch"], ["shuffle", "doc_id"]), ["source", "epoch"], ["shuffle", "doc_id"], F.col("tokens"), "upto")
    middle = (F.col("epoch") - 1) * F.col("available") + F.col("upto") - F.col("tokens") / 2
    drawn = summed.withColumn("y", middle / F.col("demand")).where("y < 1")
    a, b = F.col("start"), 1 - F.col("start")
    root = 2 * F.col("y") / (a + F.sqrt(a * a + 4 * b * F.col("y")))
    timed = drawn.withColumn("at", F.round(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)), 12))
    lean = timed.select(F.lit(0).alias("whole"), "at", "source", "doc_id", "epoch", "tokens")
    order = ["at", "source", "doc_id", "epoch"]
    ranked = running(blocks(lean, ["whole"], order), ["whole"], order, name="position")
    return ranked.select("position", "source", "doc_id", "epoch", "tokens", "at")


def shares(drawn: DataFrame, demand: DataFrame) -> DataFrame:
    """Shares reached per source: source, target_share, reached_share, tokens, repeats, max_repeats."""
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = got.agg(F.sum("tokens")).first()[0] or 0
    rows = demand.join(got, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select(
        "source",
        "target_share",
        F.round(tokens / F.lit(float(max(total, 1))), 6).alias("reached_share"),
        tokens.alias("tokens"),
        F.round(F.coalesce(F.try_divide(tokens, F.col("available")), F.lit(0.0)), 6).alias("repeats"),
        "max_repeats",
    )


def drawn_documents(documents: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its demands."""
    documents = cut(documents)
    demand = cut(demands(documents, targets, total))
    return mixture(documents, demand), demand
