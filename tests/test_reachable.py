"""Ancestors and descendants against a search, on graphs of many shapes; long chains take few jobs."""

import random

import pytest
from pyspark.sql import functions as F

from hyperlake.operators import eventlog


def brute(edges, targets, forward):
    out = set()
    for run, t in targets:
        stack, seen = [t], set()
        while stack:
            x = stack.pop()
            for r, c, e in edges:
                a, b = (c, e) if forward else (e, c)
                if r == run and a == x and b not in seen:
                    seen.add(b)
                    stack.append(b)
        out |= {(run, t, x) for x in seen}
    return out


def shapes():
    r = random.Random(4)
    name = lambda i: f"e{i:04}"
    yield [("r", name(i), name(i + 1)) for i in range(40)]
    yield [("r", name(i), name(j)) for i in range(40) for j in range(i + 1, 40) if r.random() < 0.08] + [("s", name(i), name(i + 2)) for i in range(20)]
    # two chains with edges to and fro
    yield [("r", f"a{i:02}", f"a{i + 1:02}") for i in range(20)] + [("r", f"b{i:02}", f"b{i + 1:02}") for i in range(20)] + [("r", f"a{i:02}", f"b{i + 1:02}") for i in range(0, 20, 3)] + [("r", f"b{i:02}", f"a{i + 1:02}") for i in range(1, 20, 4)]
    # a fan and a cycle
    yield [("r", "hub", name(i)) for i in range(20)] + [("r", name(i), "sink") for i in range(20)] + [("r", "x", "y"), ("r", "y", "z"), ("r", "z", "x"), ("r", "z", "hub")]


@pytest.mark.parametrize("k", range(4))
@pytest.mark.parametrize("forward", [False, True])
def test_against_search(spark, k, forward):
    edges = list(shapes())[k]
    nodes = sorted({(r, x) for r, *e in edges for x in e})
    targets = random.Random(k).sample(nodes, 6) + [("r", "unknown")]
    got = eventlog.reachable(spark.createDataFrame(edges, "run_id string, cause string, effect string"), spark.createDataFrame(targets, "run_id string, event_id string"), forward=forward)
    rows = [tuple(x) for x in got.select("run_id", "target", "event_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(edges, targets, forward)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    cuts, cut = [], eventlog.cut
    monkeypatch.setattr(eventlog, "cut", lambda df: cuts.append(1) or cut(df))
    edges = spark.range(10_000).select(F.lit("r").alias("run_id"), F.format_string("e%06d", "id").alias("cause"), F.format_string("e%06d", F.col("id") + 1).alias("effect"))
    target = spark.createDataFrame([("r", "e010000")], "run_id string, event_id string")
    assert eventlog.reachable(edges, target).count() == 10_000
    assert len(cuts) <= 20
