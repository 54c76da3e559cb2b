"""Segmented scans against plain loops, with groups that hold most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from garner.operators.components import connected_components
from garner.operators.history import attribute_hash, merge_type_two, versions_from_sightings
from garner.operators.segments import blocks, neighbour, running
from garner.operators.windows import context, latest


def sample(seed, n=3000):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.6 else None if r.random() < 0.1 else f"k{r.randrange(30)}", r.randrange(50), i, r.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_running_and_neighbours(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame(rows, "k string, t int, id int, w int")
    tagged = blocks(df, ["k"], ["t", "id"])
    got = {r["id"]: (r["n"], r["s"]) for r in running(running(tagged, ["k"], ["t", "id"], name="n"), ["k"], ["t", "id"], F.col("w"), "s").collect()}
    near = {r["id"]: (r["prev_id"], r["next_id"]) for r in neighbour(neighbour(tagged, ["k"], ["t", "id"], ["id"], "prev_"), ["k"], ["t", "id"], ["id"], "next_", after=True).collect()}
    groups = {}
    for k, t, i, w in rows:
        groups.setdefault(k, []).append((t, i, w or 0))
    for members in groups.values():
        members.sort()
        total = 0
        for n, (_, i, w) in enumerate(members):
            total += w
            assert got[i] == (n + 1, total)
            assert near[i] == (members[n - 1][1] if n else None, members[n + 1][1] if n + 1 < len(members) else None)


def test_empty_scans(spark):
    df = spark.createDataFrame([], "k string, t int, id int")
    assert running(blocks(df, ["k"], ["t", "id"]), ["k"], ["t", "id"]).count() == 0
    assert neighbour(blocks(df, ["k"], ["t", "id"]), ["k"], ["t", "id"], ["id"], "p_").count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3), (4, None)]
    parent = {i: i for i in [*range(300), *range(1000, 1201)]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    nodes = spark.createDataFrame([(i,) for i in parent], "node int")
    got = {x["node"]: x["component"] for x in connected_components(nodes, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: find(i) for i in parent}
    assert connected_components(nodes, spark.createDataFrame([], "a int, b int")).where("node <> component").count() == 0


def test_versions(spark):
    sightings = [("n", 1, "a"), ("n", 2, "a "), ("n", 3, "b"), ("n", 4, None), ("n", 5, "b"), ("n", 6, "a"), ("m", 1, None), ("m", 2, "x"), (None, 1, "z"), ("n", None, "q")]
    df = spark.createDataFrame([(n, i, t, x) for i, (n, t, x) in enumerate(sightings)], "n string, i int, t int, x string").withColumn("at", F.timestamp_seconds("t"))
    rows = df.select("n", "i", "at", attribute_hash(F.col("x")).alias("h"), F.col("x").isNull().alias("gone"))
    got = versions_from_sightings(rows, "n", "i", "at", "h", "gone")
    shown = sorted((r["n"], r["version_no"], r["f"], r["t"]) for r in got.select("n", "version_no", F.unix_seconds("valid_from").alias("f"), F.unix_seconds("valid_to").alias("t")).collect())
    assert shown == [("m", 1, 2, None), ("n", 1, 1, 3), ("n", 2, 3, 4), ("n", 3, 5, 6), ("n", 4, 6, None)]


def test_type_two_merge(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "k string, v string").select("k", "v", attribute_hash(F.col("v")).alias("attribute_hash"), at(1).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    new = spark.createDataFrame([("a", "x "), ("b", "z"), ("d", "n"), (None, "q")], "k string, v string").withColumn("at", at(5))
    out = merge_type_two(old, new, "k", "at", ["v"])
    got = sorted((r["k"], r["v"] or "", r["f"], r["t"] or 0) for r in out.select("k", "v", F.unix_seconds("valid_from").alias("f"), F.unix_seconds("valid_to").alias("t")).collect())
    assert got == [("a", "x", 1, 0), ("b", "y", 1, 5), ("b", "z", 5, 0), ("c", "", 1, 0), ("d", "n", 5, 0)]


def test_context_and_latest(spark):
    df = spark.createDataFrame([("a", i, i == 5) for i in range(10)] + [("b", 0, True)], "k string, t int, hit boolean")
    got = sorted((r["k"], r["offset"], r["t"], r["more_before"], r["more_after"]) for r in context(df, ["k"], ["t"], F.col("hit"), 2, 7).collect())
    assert got == [("a", o, 5 + o, True, False) for o in (-2, -1, 0, 1, 2, 3, 4)] + [("b", 0, 0, False, False)]
    assert latest(df, ["k"], ["t"]).where("k = 'a'").first()["t"] == 9
