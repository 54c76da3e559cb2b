"""Texts of varying length in containers of fixed capacity.

Documents are dealt into random groups; each group is packed by itself, first fit decreasing. A
tournament tree over the containers' free room finds the first container with enough room in
logarithmic time. Groups are large enough that the loss at their ends is small, and bounded, so
that a task's memory is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a group on average.
GROUP = 20_000
SEED = 7
#: Capacities are settings, not data: more rows than this are an error of the caller.
MOST_SPECS = 1_000


class Tournament:
    """Free room of containers in a binary tree whose inner nodes hold the larger room below."""

    def __init__(self, containers: int, capacity: int) -> None:
        self.leaves = 1 << max(1, (containers - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Index of the first container with room for ``size``; its room shrinks by it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        node //= 2
        while node:
            top = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == top:
                break
            room[node] = top
            node //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, items taken by falling size; no item may exceed ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(max(1, len(sizes)), capacity)
    out = np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        out[i] = tree.place(int(sizes[i]))
    return out


def packed(items: DataFrame, specs: DataFrame, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """Container of every text, for every capacity.

    ``items``: doc_id, tokens; ``specs``: spec, capacity_tokens, a small table. A text longer than
    the capacity is cut into parts that fill whole containers and a rest; no other text is cut.
    Returns spec, doc_id, part_no, token_from, token_to, container, room: the container's unused
    tokens. Texts without tokens take no room. Capacities below 1 and nulls are left out;
    more than ``MOST_SPECS`` others raise an error.
    """
    total = items.count()
    groups = max(1, -(-total // group))
    sized = items.where("tokens is not null and doc_id is not null").withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(groups)).cast("int"))
    given = specs.where("capacity_tokens >= 1 and spec is not null").limit(MOST_SPECS + 1).collect()
    if len(given) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    wanted = [F.struct(F.lit(r["spec"]).alias("spec"), F.lit(int(r["capacity_tokens"])).cast("long").alias("capacity")) for r in given]
    schema = "spec string, doc_id long, part_no int, token_from long, token_to long, container string, room long"
    if not wanted:
        return items.sparkSession.createDataFrame([], schema)
    both = sized.withColumn("s", F.explode(F.array(*wanted))).select("doc_id", "tokens", "group", "s.spec", "s.capacity")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        spec, g = key[0], key[1]
        capacity = int(rows["capacity"].iloc[0])
        rows = rows.sort_values("doc_id")
        docs, sizes = rows["doc_id"].to_numpy(), rows["tokens"].to_numpy()
        pieces = np.maximum(1, -(-sizes // capacity))
        doc = np.repeat(docs, pieces)
        part = np.concatenate([np.arange(n) for n in pieces])
        start = part * capacity
        size = np.minimum(capacity, np.repeat(sizes, pieces) - start)
        at = first_fit_decreasing(size, capacity)
        used = np.bincount(at, weights=size).astype(np.int64)
        return pd.DataFrame(
            {"spec": spec, "doc_id": doc, "part_no": part + 1, "token_from": start, "token_to": start + size, "container": [f"{spec}:{g}:{x}" for x in at], "room": capacity - used[at]}
        )

    return both.groupBy("spec", "group").applyInPandas(run, schema)


def usage(placed: DataFrame) -> DataFrame:
    """Containers, used and unused tokens per spec: spec, containers, used, unused, unused_share."""
    boxes = placed.groupBy("spec", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"), F.max("room").alias("room"))
    sums = boxes.groupBy("spec").agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum("room").alias("unused"))
    return sums.withColumn("unused_share", F.round(F.col("unused") / (F.col("used") + F.col("unused")), 6))
