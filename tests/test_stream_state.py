"""Streaming folds: pieces of a key merged from the state store, prefix outage, ids remembered entry by entry."""

import random

import pytest

from hyperlake.operators import outage
from hyperlake.streaming import stateful as st

KIND = "run_id string, event_id string, t double, namespace int, sequence int, x double, `_odd name` string"


@pytest.fixture
def small_pieces(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def drained(spark, path, batches, run):
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{path}/in")
        st.drain(run(spark.readStream.schema(KIND).parquet(f"{path}/in")), f"{path}/out")
    return spark.read.parquet(f"{path}/out/rows").collect()


def test_a_key_of_many_pieces_is_folded_in_order(small_pieces, tmp_path):
    r = random.Random(1)
    rows = [("hot", f"e{k}", float(k % 400), k % 3, k, float(k), "x") for k in range(1000)] + [("cold", "c", 1.0, 0, 0, 1.0, None)]
    r.shuffle(rows)
    got = drained(small_pieces, tmp_path, [rows[:600], rows[600:]], lambda s: st.statistics(s, ["run_id"], ["t", "sequence"], "x", alpha=0.5))
    want = []
    for part in (rows[:600], rows[600:]):
        want += sorted((x for x in part if x[0] == "hot"), key=lambda x: (x[2], x[4]))
    ema, seen = None, {}
    for n, row in enumerate(want, 1):
        ema = row[5] if ema is None else 0.5 * row[5] + 0.5 * ema
        seen[n] = (row[2], ema)
    hot = {g["n"]: (g["t"], g["ema"]) for g in got if g["run_id"] == "hot"}
    assert hot.keys() == seen.keys() and all(hot[n][0] == seen[n][0] and abs(hot[n][1] - seen[n][1]) < 1e-9 for n in seen)


def test_ids_that_are_too_old_can_be_forgotten(spark, tmp_path):
    event = lambda e, t: ("r", e, t, 0, 0, 0.0, None)
    batches = [[event("a", 0.0), event("b", 50.0)], [event("b", 90.0), event("c", 200.0)], [event("a", 210.0), event("c", 220.0)]]
    got = drained(spark, tmp_path, batches, lambda s: st.ordered_ingest(s, keep_seconds=100.0))
    assert sorted((g["event_id"], g["t"], g["status"]) for g in got) == [
        ("a", 0.0, "accepted"), ("a", 210.0, "accepted"), ("b", 50.0, "accepted"), ("b", 90.0, "duplicate"), ("c", 200.0, "accepted"), ("c", 220.0, "duplicate"),
    ]


def series(r):
    return [r.choice([0.9, 0.95, 0.5, r.uniform(0.45, 0.99)]) if r.random() < 0.5 else (0.92 if i < 20 else 0.6) + r.uniform(-0.05, 0.05) for i in range(r.randrange(1, 90))] + r.choice([[], [0.0, 0.7], [1.0, 0.7], [0.3]])


def test_outage_of_every_prefix(spark):
    r = random.Random(2)
    given = {f"s{k}": series(r) for k in range(30)}
    df = spark.createDataFrame([(k, i, x) for k, xs in given.items() for i, x in enumerate(xs)], "k string, i int, x double").repartition(5)
    want = {(k, i): st.infer_outage(xs[: i + 1]) for k, xs in given.items() for i in range(len(xs))}
    assert set(want.values()) == {True, False}
    for block in (7, 1 << 16):
        assert {(g["k"], g["i"]): g["available"] for g in outage.outage_prefix(df, ["k"], ["i"], "x", block=block).collect()} == want
    one = df.filter("k = 's3'").drop("k")
    got = outage.outage_prefix(one, [], ["i"], "x", block=7).collect()
    assert {("s3", g["i"]): g["available"] for g in got} == {k: v for k, v in want.items() if k[0] == "s3"}


def test_null_values_repeat_what_holds(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 0.0), ("a", 2, None), ("a", 3, 1.0)], "k string, i int, x double")
    assert {g["i"]: g["available"] for g in outage.outage_prefix(df, ["k"], ["i"], "x").collect()} == {0: None, 1: False, 2: False, 3: True}
    assert outage.outage_prefix(df.limit(0), ["k"], ["i"], "x").count() == 0


def test_merged_hulls_are_those_of_the_whole():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(2, 30)
        totals = [r.uniform(-3, 3) for _ in range(n)]
        merged = outage.point(0, totals[0])
        for i in range(1, n):
            merged = outage.merge(merged, outage.point(i, totals[i]))
        for c in (-2.0, 0.0, 0.3, 1.7):
            brute = max((j - i) * c - (totals[j] - totals[i]) for i in range(n) for j in range(i, n))
            assert abs(outage.largest_drop([merged], c) - max(brute, 0.0)) < 1e-9


class Store(dict):
    """The calls of a state store's map, counted."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)


@pytest.fixture
def in_memory(monkeypatch):
    """The step of an operator over batches of rows, with stores that count."""
    def run(operator, batches):
        got = {}
        monkeypatch.setattr(st, "fold", lambda stream, keys, order, output, state, initial, step, maps=None: got.update(step=step, now=initial, maps=maps or {}))
        operator()
        stores, out, state = {m: Store() for m in got["maps"]}, [], got["now"]
        for k, rows in enumerate(batches):
            maps = {m: st._Held(s, k == 0) for m, s in stores.items()}
            for row in rows:
                state, made = got["step"](state, row, maps)
                out.append(made)
            for held in maps.values():
                held.flush()
        return out, stores

    return run


@pytest.mark.parametrize("held", [3, 2048])
@pytest.mark.parametrize("keep", [None, 40.0])
def test_ids_share_entries_of_the_state_store(in_memory, monkeypatch, held, keep):
    from types import SimpleNamespace

    monkeypatch.setattr(st, "HELD", held)
    r, want, known, last = random.Random(4), [], {}, float("-inf")
    batches = [[SimpleNamespace(event_id=f"e{r.randrange(3000)}", t=float(k * 8 + i // 250 - (r.random() < 0.1) * 9)) for i in range(2000)] for k in range(3)]
    for row in [x for b in batches for x in b]:
        was = known.get(row.event_id)
        status = "duplicate" if was is not None and (keep is None or was >= row.t - keep) else "late" if row.t < last else "accepted"
        want.append((row.event_id, row.t, status))
        if status == "accepted":
            known[row.event_id], last = row.t, row.t
    out, stores = in_memory(lambda: st.ordered_ingest(None, keep_seconds=keep), batches)
    assert out == want and {s for *_, s in want} == {"accepted", "late", "duplicate"}
    import json

    assert held == 3 or stores["ids"].calls < 600
    assert keep is not None or {k for (text,) in stores["ids"].values() for k in json.loads(text)} == set(known)


def test_prefix_sums_share_entries_of_the_state_store(in_memory):
    from types import SimpleNamespace

    r = random.Random(5)
    xs = [x for _ in range(12) for x in series(r)]
    rows = [SimpleNamespace(t=i, x=x) for i, x in enumerate(xs)]
    out, stores = in_memory(lambda: st.outage(None, ["k"], ["t"], "x"), [rows[:200], rows[200:203], rows[203:]])
    says = [st.infer_outage(xs[: i + 1]) for i in range(len(xs))]
    assert out == [(float(i), now) if i == 0 or now != says[i - 1] else None for i, now in enumerate(says)] and set(says) == {True, False}
    assert stores["sums"].calls < len(xs) / 4 and len(stores["sums"]) <= len(xs) / 64 / 2 + 2
