"""Scans over split keys equal scans over whole keys."""

import random

import pytest
from pyspark.sql import functions as F

from hyperlake import ordered as od
from hyperlake.operators import inventory as inv



def scans():
    return {
        "s": od.rsum("x"), "sx": od.rsum("x", inclusive=False), "lo": od.rmin("x"), "hi": od.rmax("x", inclusive=False), "la": od.rlast("y"),
        "lx": od.rlast("y", inclusive=False), "nx": od.rnext("y"), "lg": od.rlag("y"), "ld": od.rlead("x", -1), "rn": od.rnumber(),
    }


NAMES = ("s", "sx", "lo", "hi", "la", "lx", "nx", "lg", "ld", "rn")


def series(spark, n=200, hot=0.6):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(20)}"
        rows.append((key, float(rng.randrange(60)), i, rng.randrange(10), rng.randrange(9) if rng.random() < 0.4 else None))
    return spark.createDataFrame(rows, "k STRING, t DOUBLE, i INT, x INT, y INT")


def rows(df):
    return sorted(map(tuple, df.select("k", "t", "i", *NAMES).collect()))


def test_split_equals_whole(spark):
    df = series(spark)
    whole = rows(od.running(df, ["k"], ["t", "i"], scans()))
    split = od.split_hot(df, ["k"], "t", limit=7)
    assert od.CHUNK in split.columns
    assert split.filter("k = 'hot'").select(od.CHUNK).distinct().count() > 3
    assert rows(od.running(split, ["k"], ["t", "i"], scans())) == whole


def test_small_keys_are_not_split(spark):
    assert od.CHUNK not in od.split_hot(series(spark), ["k"], "t", limit=10_000).columns


def test_quantiles_and_ranks(tiny_chunks):
    df = tiny_chunks.createDataFrame([(float(v),) for v in (1, 2, 4)], "v DOUBLE")
    got = od.quantiles(df, [], "v", {"q05": 0.05, "m": 0.5, "q95": 0.95}).first()
    assert [round(x, 6) for x in got] == [1.1, 2.0, 3.8]
    ties = tiny_chunks.createDataFrame([("a", float(v)) for v in (3, 1, 3, 2, 3, 9, 9, 0)], "g STRING, v DOUBLE")
    ranks = {r["v"]: r["r"] for r in od.rank_average(ties, ["g"], "v", "r").collect()}
    assert ranks == {0.0: 1.0, 1.0: 2.0, 2.0: 3.0, 3.0: 5.0, 9.0: 7.5}


def stock(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randrange(4)}", i, rng.choice(["receive", "reserve", "release", "reserve"]), rng.randrange(1, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "sku STRING, t INT, kind STRING, quantity INT"), rows


def expected_ledger(rows):
    state, out = {}, []
    for sku, t, kind, q in rows:
        on_hand, reserved = state.get(sku, (0, 0))
        ok = kind == "receive" or (kind == "reserve" and q <= on_hand - reserved) or (kind == "release" and q <= reserved)
        if ok:
            on_hand += q if kind == "receive" else 0
            reserved += {"receive": 0, "reserve": q, "release": -q}[kind]
        state[sku] = (on_hand, reserved)
        out.append((sku, t, "applied" if ok else "rejected", on_hand, reserved))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_split_and_whole(spark, seed):
    df, rows_in = stock(spark, seed=seed)
    want = expected_ledger(rows_in)
    pick = ["sku", "t", "status", "on_hand", "reserved"]
    assert sorted(map(tuple, inv.ledger(df).select(*pick).collect())) == want
    spark.conf.set("hyperlake.rowsPerChunk", "12")
    try:
        assert sorted(map(tuple, inv.ledger(df).select(*pick).collect())) == want
    finally:
        spark.conf.unset("hyperlake.rowsPerChunk")


def test_availability_golden(spark):
    rows_in = [("a", 0, "receive", 8), ("a", 1, "reserve", 3), ("a", 2, "reserve", 6), ("a", 3, "release", 2)]
    df = spark.createDataFrame(rows_in, "sku STRING, t INT, kind STRING, quantity INT")
    led = inv.ledger(df)
    assert [r["status"] for r in led.orderBy("t").collect()] == ["applied", "applied", "rejected", "applied"]
    want = spark.createDataFrame([("a",), ("zz",)], "sku STRING")
    got = {r["sku"]: (r["on_hand"], r["reserved"], r["available"]) for r in inv.availability(want, led).collect()}
    assert got == {"a": (8, 1, 7), "zz": (0, 0, 0)}


def test_chunk_is_order_preserving(spark):
    d = od.split_hot(series(spark), ["k"], "t", limit=7)
    bad = d.alias("a").groupBy("k", od.CHUNK).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    per = {}
    for r in bad.collect():
        per.setdefault(r["k"], []).append((r[od.CHUNK], r["lo"], r["hi"]))
    for spans in per.values():
        spans.sort()
        assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_crowded_instant_is_split_by_the_next_column(spark):
    """Most rows of the hot key share one time; the sequence number splits them."""
    rows_in = [("hot", 5.0 if i % 10 else float(i), i, i % 7, None if i % 3 else i % 5) for i in range(400)] + [("cold", 1.0, 0, 1, 1)]
    df = spark.createDataFrame(rows_in, "k STRING, t DOUBLE, i INT, x INT, y INT")
    split = od.split_hot(df, ["k"], ["t", "i"], limit=30)
    assert max(r["count"] for r in split.groupBy("k", od.CHUNK).count().collect()) <= 30
    assert rows(od.running(split, ["k"], ["t", "i"], scans())) == rows(od.running(df, ["k"], ["t", "i"], scans()))
