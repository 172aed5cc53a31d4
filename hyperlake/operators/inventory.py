"""Stock ledgers: an ordered fold with rejections, kept parallel for a hot item.

A reserve above what is available and a release above what is reserved are
rejected and change nothing, so the fold is not a plain prefix sum.  But inside a
chunk the accept/reject pattern stays the same for every starting state within
simple bounds, and then the chunk only adds fixed amounts.  Each chunk is folded
for a guessed start and reports those bounds; chaining the chunk reports per item
is cheap; chunks whose true start falls outside their bounds are folded again.
The loop ends when every start is confirmed, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ordered
from ..session import cut

KINDS = ("receive", "reserve", "release")
_INF = float("inf")


def fold(kinds: np.ndarray, qty: np.ndarray, available: int, reserved: int):
    """Statuses, states after each row and the bounds in which they would not change."""
    kinds, qty = kinds.tolist(), qty.tolist()
    ok, free, held = [], [], []
    a, r = available, reserved
    lo_a, hi_a, lo_r, hi_r = -_INF, _INF, -_INF, _INF
    for kind, q in zip(kinds, qty, strict=True):
        fine = False
        if kind == "receive":
            a, fine = a + q, True
        elif kind == "reserve":
            if a >= q:
                lo_a = max(lo_a, available - a + q)
                a, r, fine = a - q, r + q, True
            else:
                hi_a = min(hi_a, available - a + q)
        elif kind == "release":
            if r >= q:
                lo_r = max(lo_r, reserved - r + q)
                a, r, fine = a + q, r - q, True
            else:
                hi_r = min(hi_r, reserved - r + q)
        ok.append(fine)
        free.append(a)
        held.append(r)
    made = np.array(ok, dtype=bool), np.array(free, dtype=np.int64), np.array(held, dtype=np.int64)
    return *made, (a - available, r - reserved, lo_a, hi_a, lo_r, hi_r)


def ledger(events: DataFrame, keys: Sequence[str] = ("sku",), order: Sequence[str] = ("t",)) -> DataFrame:
    """Add ``status`` (applied / rejected), ``on_hand`` and ``reserved`` after every event.

    ``events``: keys, order columns, kind in receive / reserve / release, quantity.
    """
    keys, order = list(keys), list(order)
    df = ordered.split_hot(events, keys, order)
    fields = [f"`{n}` {t}" for n, t in events.dtypes]
    schema = ", ".join([*fields, "status STRING", "on_hand BIGINT", "reserved BIGINT"])
    names = [n for n, _ in events.dtypes]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, a, r = None, 0, 0
        for pdf in batches:
            out = pdf[names].copy()
            if not len(pdf):
                yield out.assign(status=pd.Series(dtype=str), on_hand=0, reserved=0)
                continue
            # rows come sorted by item: one fold for each item of a batch, from where the last batch left it
            changes = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            starts = np.unique(np.concatenate(([0], changes)))
            kinds, qty = pdf["kind"].to_numpy(), pdf["quantity"].to_numpy()
            parts = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
                item = tuple(pdf[k].iloc[start] for k in keys)
                if item != now:
                    now, a, r = item, 0, 0
                ok, free, taken, _ = fold(kinds[start:end], qty[start:end], a, r)
                a, r = int(free[-1]), int(taken[-1])
                parts.append((ok, free, taken))
            ok, free, held = (np.concatenate(x) for x in zip(*parts, strict=True))
            out["status"], out["on_hand"], out["reserved"] = np.where(ok, "applied", "rejected"), free + held, held
            yield out

    def replay(pdf: pd.DataFrame, a: int, r: int) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        ok, free, held, _ = fold(pdf["kind"].to_numpy(), pdf["quantity"].to_numpy(), a, r)
        out = pdf[names].copy()
        out["status"] = np.where(ok, "applied", "rejected")
        out["on_hand"], out["reserved"] = free + held, held
        return out

    if ordered.CHUNK not in df.columns:
        # whole items per partition, streamed batch by batch with the running state
        return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(stream, schema)

    part = [*keys, ordered.CHUNK]
    key_fields = [f"`{k}` {dict(df.dtypes)[k]}" for k in part]
    df = cut(df)
    start = df.select(*part).distinct().withColumns({"a": F.lit(0).cast("long"), "r": F.lit(0).cast("long")})
    start = cut(start)

    def report(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, r = int(right["a"].iloc[0]), int(right["r"].iloc[0])
        left = left.sort_values(order)
        *_, rep = fold(left["kind"].to_numpy(), left["quantity"].to_numpy(), a, r)
        head = [right[k].iloc[0] for k in part]
        return pd.DataFrame([[*head, a, r, *rep]], columns=[*part, "a", "r", "da", "dr", "lo_a", "hi_a", "lo_r", "hi_r"])

    report_schema = ", ".join([*key_fields, "a BIGINT, r BIGINT, da BIGINT, dr BIGINT, lo_a DOUBLE, hi_a DOUBLE, lo_r DOUBLE, hi_r DOUBLE"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.CHUNK)
        a = r = 0
        rows = []
        heads = pdf[part].itertuples(index=False, name=None)
        reps = pdf[["da", "dr", "lo_a", "hi_a", "lo_r", "hi_r"]].itertuples(index=False, name=None)
        for head, (da, dr, lo_a, hi_a, lo_r, hi_r) in zip(heads, reps):
            fits = lo_a <= a < hi_a and lo_r <= r < hi_r
            rows.append((*head, a, r, not fits))
            a, r = a + da, r + dr
        return pd.DataFrame(rows, columns=[*part, "a", "r", "again"])

    chain_schema = ", ".join([*key_fields, "a BIGINT, r BIGINT, again BOOLEAN"])
    reports = cut(df.groupBy(*part).cogroup(start.groupBy(*part)).applyInPandas(report, report_schema))
    while True:
        # one summary row per chunk of an item, never its events
        start = cut(reports.groupBy(*keys).applyInPandas(chain, chain_schema))
        redo = start.filter("again").select(*part, "a", "r")
        if redo.isEmpty():
            break
        fresh = df.join(redo.select(*part), part, "left_semi").groupBy(*part).cogroup(redo.groupBy(*part)).applyInPandas(report, report_schema)
        reports = cut(reports.join(redo.select(*part), part, "left_anti").unionByName(fresh))

    def final(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return replay(left, int(right["a"].iloc[0]), int(right["r"].iloc[0]))

    return df.groupBy(*part).cogroup(start.groupBy(*part)).applyInPandas(final, schema)


def availability(skus: DataFrame, states: DataFrame, keys: Sequence[str] = ("sku",), order: Sequence[str] = ("t",)) -> DataFrame:
    """on_hand, reserved and available of every asked item; unknown items are zero."""
    last = states.groupBy(*keys).agg(F.max_by(F.struct("on_hand", "reserved"), F.struct(*order)).alias("_s"))
    got = skus.select(*keys).distinct().join(last, list(keys), "left")
    got = got.select(*keys, F.coalesce("_s.on_hand", F.lit(0)).alias("on_hand"), F.coalesce("_s.reserved", F.lit(0)).alias("reserved"))
    return got.withColumn("available", F.col("on_hand") - F.col("reserved"))


def decode_event(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Strict decoding: exactly event_id, sku, kind, quantity; null ``problem`` when valid.

    Quantity must be a positive JSON integer: the raw text decides, so ``true``,
    ``2.0`` and ``"2"`` are all refused.
    """
    v = F.try_parse_json(F.col(column))
    as_map = F.from_json(F.col(column), "map<string,string>")
    kinds = F.schema_of_variant(F.try_variant_get(v, "$.quantity", "variant"))
    d = raw.withColumns({"_v": v, "_m": as_map, "_k": kinds})
    text = lambda f: F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{f}", "variant")) == "STRING"
    qty = F.try_variant_get(F.col("_v"), "$.quantity", "bigint")
    problem = (
        F.when(F.col("_v").isNull() | F.col("_m").isNull(), "not_an_object")
        .when(F.array_sort(F.map_keys("_m")) != F.array(*[F.lit(k) for k in ("event_id", "kind", "quantity", "sku")]), "wrong_fields")
        .when(~text("event_id") | ~text("sku") | ~text("kind") | (F.col("_m")["event_id"] == "") | (F.col("_m")["sku"] == ""), "bad_text")
        .when(~F.col("_m")["kind"].isin(*KINDS), "unknown_kind")
        .when((F.col("_k") != "BIGINT") | (qty <= 0), "bad_quantity")
    )
    d = d.withColumn("problem", problem)
    ok = F.col("problem").isNull()
    return d.select(
        *raw.columns, "problem", F.when(ok, F.col("_m")["event_id"]).alias("event_id"), F.when(ok, F.col("_m")["sku"]).alias("sku"),
        F.when(ok, F.col("_m")["kind"]).alias("kind"), F.when(ok, F.try_variant_get(F.col("_v"), "$.quantity", "bigint")).alias("quantity"),
    )


