"""Containers and mixtures against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from garner.llm import mixing, packing
from garner.llm.tokens import with_token_counts


def plain_first_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, r in enumerate(rooms) if r >= sizes[i]), None)
        if at is None:
            rooms.append(capacity)
            at = len(rooms) - 1
        rooms[at] -= sizes[i]
        out[i] = at
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tournament_is_first_fit(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, r.randrange(101)]) for _ in range(r.choice([1, 2, 60, 300]))]
    assert packing.first_fit_decreasing(np.array(sizes), 100).tolist() == plain_first_fit(sizes, 100)


def test_too_many_capacities_raise(spark):
    items = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    specs = spark.range(packing.MOST_SPECS + 1).selectExpr("cast(id as string) as spec", "id + 1 as capacity_tokens")
    with pytest.raises(ValueError, match="capacities"):
        packing.packed(items, specs)


def test_packing(spark):
    r = random.Random(3)
    items = [(i, r.randrange(0, 350)) for i in range(400)] + [(1000, 0), (1001, 100), (1002, 201), (1003, None), (None, 5)]
    specs = spark.createDataFrame([("s", 100), ("l", 300), ("zero", 0), (None, 10)], "spec string, capacity_tokens int")
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    rows = packing.packed(df, specs, group=120).collect()
    assert {x["spec"] for x in rows} == {"s", "l"}
    for spec, capacity in (("s", 100), ("l", 300)):
        held, parts = {}, {}
        for x in rows:
            if x["spec"] == spec:
                held.setdefault(x["container"], []).append(x["token_to"] - x["token_from"])
                parts.setdefault(x["doc_id"], []).append((x["part_no"], x["token_from"], x["token_to"]))
                assert x["room"] >= 0
        assert all(sum(v) <= capacity for v in held.values())
        rooms = {x["container"]: x["room"] for x in rows if x["spec"] == spec}
        assert all(capacity - sum(v) == rooms[c] for c, v in held.items())
        for doc, tokens in items:
            if doc is None or tokens is None:
                assert doc not in parts or doc is None
                continue
            got = sorted(parts[doc])
            assert [p for p, _, _ in got] == list(range(1, len(got) + 1)) and len(got) == max(1, -(-tokens // capacity))
            assert got[0][1] == 0 and got[-1][2] == tokens and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    use = {x["spec"]: x for x in packing.usage(packing.packed(df, specs)).collect()}
    assert use["l"]["unused_share"] < 0.02 and use["s"]["used"] == sum(t for d, t in items if d is not None and t)
    assert packing.packed(df.where("false"), specs).count() == 0
    assert packing.packed(df, specs.where("false")).count() == 0


def test_mixture(spark):
    r = random.Random(4)
    docs = [(i, s, r.randrange(1, 60)) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["small"] * 60)] + [(5000, "big", 0), (5001, None, 5), (None, "big", 5), (5002, "unlisted", 9)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.0, 3), ("none", None, None)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    drawn, demand = mixing.drawn_documents(df, targets)
    rows = sorted(drawn.collect(), key=lambda x: x["position"])
    assert [x["position"] for x in rows] == list(range(1, len(rows) + 1))
    assert all(a["at"] <= b["at"] for a, b in zip(rows, rows[1:], strict=False))
    report = {x["source"]: x for x in mixing.shares(drawn, demand).collect()}
    for s, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert abs(report[s]["reached_share"] - share) < 0.01
        assert report[s]["repeats"] <= cap
    uses = {}
    for x in rows:
        uses[(x["source"], x["doc_id"])] = uses.get((x["source"], x["doc_id"]), 0) + 1
    assert all(n <= {"big": 1, "mid": 2, "small": 4}[s] for (s, _), n in uses.items())
    assert report["absent"]["tokens"] == 0
    # an early stretch is flatter than a late one
    third = len(rows) // 3
    early, late = (sum(x["tokens"] for x in part if x["source"] == "small") / sum(x["tokens"] for x in part) for part in (rows[:third], rows[-third:]))
    assert early > late
    assert mixing.drawn_documents(df.where("false"), targets)[0].count() == 0


def test_token_counts(spark):
    from garner.llm.tokens import FOLDER, VOCABULARY, tokenizer

    texts = [(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> ordinary"), (5, "é" * 20_000)]
    got = {r["id"]: r["tokens"] for r in with_token_counts(spark.createDataFrame(texts, "id long, text string"), ["id"]).collect()}
    t = tokenizer(f"{FOLDER}/{VOCABULARY}")
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts if x is not None}
    assert got[2] == 0 and got[4] > 3


def test_queries(spark, data):
    from garner.llm.plan_sizing import QUERIES

    boxes = QUERIES["p8_containers"](spark, data)
    assert boxes.where("room < 0").count() == 0
    assert abs(QUERIES["p9_shares"](spark, data).agg(F.sum("reached_share")).first()[0] - 1) < 1e-3
