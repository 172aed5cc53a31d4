"""Keyed streaming operators and their sinks.

Each operator folds the rows of a key in (t, sequence) order and keeps its state in the state store: one small value for
each key, and maps with an entry of their own for everything that grows.  Rows of a key arrive in a micro-batch unordered
and in pieces of an Arrow batch.  One piece is sorted in memory; when there are more, sorted pieces are spooled to a map
in the state store and merged from there, so no micro-batch of a key is ever gathered.  Rows that are late across batches
are the business of :func:`ordered_ingest`.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import outage as outages
from ..operators.adaptive import CUSUM_H, CUSUM_K, DROP_THRESHOLD, EMA_ALPHA, UP_LEVEL

Step = Callable[[tuple, Any, dict[str, Any]], tuple[tuple, tuple | None]]
#: rows of output handed on at a time, and rows of a spooled piece read ahead
OUT, AHEAD = 4096, 64
#: entries of a map held in memory at a time, and values that share an entry
HELD, SHARE = 2048, 64


class _Held:
    """A map of the state store whose entries, text there, are read once and written once for a micro-batch of a key.

    ``empty`` tells that the key has nothing stored, so nothing is asked for.  At most :data:`HELD` entries are held.
    """

    def __init__(self, stored: Any, empty: bool) -> None:
        self.stored, self.empty, self.held, self.changed = stored, empty, {}, set()

    def getValue(self, key: tuple) -> tuple | None:
        if key not in self.held:
            found = None if self.empty else self.stored.getValue(key)
            self._hold(key, None if found is None else (json.loads(found[0]),))
        return self.held[key]

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._hold(key, value)
        self.changed.add(key)

    def removeKey(self, key: tuple) -> None:
        if self.empty:
            self.held.pop(key, None)
            self.changed.discard(key)
        else:
            self.updateValue(key, None)

    def _hold(self, key: tuple, value: tuple | None) -> None:
        if len(self.held) >= HELD and key not in self.held:
            self.flush()
        self.held[key] = value

    def flush(self) -> None:
        for key in self.changed:
            if self.held[key] is None:
                self.stored.removeKey(key)
            else:
                self.stored.updateValue(key, (json.dumps(self.held[key][0]),))
        self.empty = self.empty and not self.changed
        self.held, self.changed = {}, set()


class _Fold(StatefulProcessor):
    """``step`` over the ordered rows of a key."""

    def __init__(self, order: list[str], rows: str, names: list[str], state: str, initial: tuple, step: Step, maps: dict[str, tuple[str, str]]) -> None:
        self.order, self.rows, self.names, self.state, self.initial, self.step, self.maps = order, rows, names, state, initial, step, maps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state)
        self.kept = {name: handle.getMapState(name, *kinds) for name, kinds in self.maps.items()}
        self.row = namedtuple("Row", self.rows.split(","), rename=True)
        self.spool = handle.getMapState("spool", "piece INT, block INT", "rows STRING")

    def _spooled(self, piece: int, blocks: int) -> Iterator[tuple]:
        for block in range(blocks):
            (text,) = self.spool.getValue((piece, block))
            self.spool.removeKey((piece, block))
            yield from (tuple(r) for r in json.loads(text))

    def _ordered(self, frames: Iterator[pd.DataFrame], row: Any) -> Iterator[Any]:
        """All rows in order: from memory if they are one piece, else merged from the spool."""
        make = lambda r: row(*[None if v is None or v is pd.NaT or v != v else v for v in r])
        # Spark gives columns whose names are no Python names others
        frames = (f.set_axis(self.rows.split(","), axis=1).sort_values(self.order, kind="stable") for f in frames)
        first, second = next(frames), next(frames, None)
        if second is None:
            yield from map(make, first.itertuples(index=False, name=None))
            return
        places = [list(first.columns).index(o) for o in self.order]
        pieces, frame, waiting = [], first, second
        while frame is not None:
            blocks = -(-len(frame) // AHEAD)
            for block in range(blocks):
                part = frame.iloc[block * AHEAD : (block + 1) * AHEAD].astype(object)
                self.spool.updateValue((len(pieces), block), (json.dumps([[None if v != v else v for v in r] for r in part.itertuples(index=False, name=None)], default=str),))
            pieces.append(blocks)
            frame, waiting = waiting, next(frames, None)
        merged = heapq.merge(*[self._spooled(p, n) for p, n in enumerate(pieces)], key=lambda r: tuple((r[i] is not None, r[i]) for i in places))
        yield from map(make, merged)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        key = tuple(key)
        known = self.value.get()
        current = self.initial if known is None else tuple(known)
        maps = {name: _Held(kept, known is None) for name, kept in self.kept.items()}
        out: list[tuple] = []
        for r in self._ordered(rows, self.row):
            current, made = self.step(current, r, maps)
            if made is not None:
                out.append((*key, *made))
                if len(out) == OUT:
                    yield pd.DataFrame(out, columns=self.names)
                    out = []
        for held in maps.values():
            held.flush()
        self.value.update(current)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def fold(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], output: str, state: str, initial: tuple, step: Step, maps: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Apply ``step(state, row, maps) -> (state, output or None)`` to every row of a key in order.

    ``output`` and ``state`` are DDL schemas; the key columns are put in front of the output.  ``maps`` names maps of the
    key (schemas of their keys and of one text each), in which ``step`` reads and writes what JSON can hold, entry by
    entry; an entry travels to the state store and back once for a micro-batch.  Columns are numbers or
    text.  The session's state store is set to RocksDB, which the maps need.
    """
    keys, order = list(keys), list(order)
    types = dict(stream.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [output])
    names = [*keys, *[c.strip().split(" ")[0] for c in output.split(",")]]
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = _Fold(order, ",".join(stream.columns), names, state, initial, step, maps or {})
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")


def ordered_ingest(stream: DataFrame, keys: Sequence[str] = ("run_id",), keep_seconds: float | None = None) -> DataFrame:
    """accepted, late or duplicate for every event of a run.

    An event earlier than the run's current time is late; an id accepted before is a
    duplicate, however long ago.  The state of a run is its clock and a map of the
    accepted ids, some :data:`SHARE` to an entry; an event reads the entry its id hashes
    to, and entries split in two as ids get more.  ``keep_seconds`` is an explicit choice
    to forget ids that are older than that and to take them as new again.  Needs t,
    namespace, sequence, event_id.
    """
    def step(s: tuple, r, maps: dict[str, Any]) -> tuple:
        (last, swept, n, parts), ids, ident, t = s, maps["ids"], str(r.event_id), float(r.t)
        place = zlib.crc32(ident.encode("utf-8", "surrogatepass"))
        mine = (ids.getValue((place % parts,)) or ({},))[0]
        known = mine.get(ident)
        if known is not None and (keep_seconds is None or known >= t - keep_seconds):
            return s, (ident, t, "duplicate")
        if t < last:
            return s, (ident, t, "late")
        n += known is None
        mine[ident] = t
        ids.updateValue((place % parts,), (mine,))
        if keep_seconds is not None and t - swept > keep_seconds:
            # once in a while what is too old is removed, entry by entry
            n = 0
            for part in range(parts):
                young = {k: v for k, v in (ids.getValue((part,)) or ({},))[0].items() if v >= t - keep_seconds}
                ids.updateValue((part,), (young,))
                n += len(young)
            swept = t
        if n > parts * SHARE:
            for part in range(parts):
                halves: tuple[dict, dict] = ({}, {})
                for k, v in (ids.getValue((part,)) or ({},))[0].items():
                    halves[zlib.crc32(k.encode("utf-8", "surrogatepass")) // parts % 2][k] = v
                ids.updateValue((part,), (halves[0],))
                ids.updateValue((part + parts,), (halves[1],))
            parts *= 2
        return (t, swept, n, parts), (ident, t, "accepted")

    return fold(
        stream, keys, ["t", "namespace", "sequence"], "event_id STRING, t DOUBLE, status STRING", "last DOUBLE, swept DOUBLE, n BIGINT, parts BIGINT", (-math.inf, -math.inf, 0, 1), step,
        {"ids": ("part BIGINT", "ids STRING")},
    )


def handle_state(stream: DataFrame, immutable: Sequence[str] = (), keys: Sequence[str] = ("handle_id",)) -> DataFrame:
    """Attribute state of the entity bound to each handle; unchanged inputs give no row.

    Needs t, sequence, mode (merge, replace, signal_only) and payload (JSON object).
    """
    def step(s: tuple, r, _: dict[str, Any]) -> tuple:
        before = json.loads(s[0])
        payload = json.loads(r.payload)
        if r.mode == "signal_only":
            return s, None
        after = {**before, **payload} if r.mode == "merge" else {**{k: before[k] for k in immutable if k in before}, **payload}
        if any(k in before and before[k] != after.get(k) for k in immutable):
            return s, (float(r.t), "rejected", s[0])
        text = json.dumps(after, sort_keys=True)
        if text == s[0]:
            return s, None
        return (text,), (float(r.t), "updated", text)

    return fold(stream, keys, ["t", "sequence"], "t DOUBLE, outcome STRING, attributes STRING", "attributes STRING", ("{}",), step)


def statistics(stream: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = EMA_ALPHA, tau: float = 1.0, rate: float = 0.01, target: float = 0.0) -> DataFrame:
    """EMA, eligibility trace and Robbins-Monro estimate after every row."""
    t = order[0]

    def step(s: tuple, r, _: dict[str, Any]) -> tuple:
        n, last, ema, trace, theta = s
        x, now = float(getattr(r, value)), float(getattr(r, t))
        ema = x if n == 0 else alpha * x + (1 - alpha) * ema
        trace = x if n == 0 else trace * math.exp(-(now - last) / tau) + x
        theta = theta + rate * (x - target)
        return (n + 1, now, ema, trace, theta), (now, n + 1, ema, trace, theta)

    return fold(stream, keys, order, "t DOUBLE, n BIGINT, ema DOUBLE, trace DOUBLE, theta DOUBLE", "n BIGINT, last DOUBLE, ema DOUBLE, trace DOUBLE, theta DOUBLE", (0, 0.0, 0.0, 0.0, 0.0), step)


def infer_outage(values: Sequence[float], drop: float = DROP_THRESHOLD, k: float = CUSUM_K, h: float = CUSUM_H) -> bool:
    """Availability from a whole series."""
    last = values[-1]
    if last <= 0:
        return False
    if last >= UP_LEVEL:
        return True
    if last < drop:
        return False
    half = values[: max(1, len(values) // 2)]
    mean = sum(half) / len(half)
    acc = 0.0
    for x in values:
        acc = max(0.0, acc - (x - mean + k))
        if acc > h:
            return False
    return True


def outage(stream: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Availability transitions only, by :mod:`hyperlake.operators.outage` over every prefix.

    The detector compares with the mean of the first half of all rows so far, so prefix sums from that half on are kept,
    :data:`SHARE` to an entry of a map of which a row reads one and writes one.  The rest of the state are hulls, one map entry for
    each power of two of rows.
    """
    def step(s: tuple, r, maps: dict[str, Any]) -> tuple:
        n, total, was = s
        x = float(getattr(r, value))
        n, total = n + 1, total + x
        (mine,) = maps["sums"].getValue((n // SHARE,)) or ([],)
        maps["sums"].updateValue((n // SHARE,), ([*mine, total],))
        half = max(1, n // 2)
        # row 1 is the first of entry 0
        (sums,) = maps["sums"].getValue((half // SHARE,))
        before = sums[half % SHARE - (half < SHARE)]
        if n % 2 == 0 and half % SHARE == 0:
            maps["sums"].removeKey((half // SHARE - 1,))
        now = outages.add_row(n, total, x, before / half, maps["hulls"])
        state = "up" if now else "down"
        return (n, total, state), ((float(getattr(r, order[0])), now) if state != was else None)

    kept = {"sums": ("block BIGINT", "totals STRING"), "hulls": ("level INT", "hulls STRING")}
    return fold(stream, keys, order, "t DOUBLE, available BOOLEAN", "n BIGINT, total DOUBLE, was STRING", (0, 0.0, ""), step, kept)


def inventory(stream: DataFrame, keys: Sequence[str] = ("sku",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Stock ledger with rejections: event_id, status, on_hand, reserved."""
    def step(s: tuple, r, _: dict[str, Any]) -> tuple:
        free, held = s
        q = int(r.quantity)
        ok = r.kind == "receive" or (r.kind == "reserve" and q <= free) or (r.kind == "release" and q <= held)
        if ok:
            free, held = {"receive": (free + q, held), "reserve": (free - q, held + q), "release": (free + q, held - q)}[r.kind]
        return (free, held), (int(r.event_id), "applied" if ok else "rejected", free + held, held)

    return fold(stream, keys, order, "event_id BIGINT, status STRING, on_hand BIGINT, reserved BIGINT", "free BIGINT, held BIGINT", (0, 0), step)


def scheduled(stream: DataFrame, names: dict[str, float], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Parameters in force at every event; rows with a parameter name are updates.

    Needs t, sequence, parameter, value and event_id; an update at the time of an
    event applies first.
    """
    order = list(names)

    def step(s: tuple, r, _: dict[str, Any]) -> tuple:
        now = json.loads(s[0])
        if r.parameter is not None and r.parameter == r.parameter and r.parameter in now:
            now[r.parameter] = float(r.value)
            return (json.dumps(now),), None
        return s, (int(r.event_id), *[now[n] for n in order])

    marked = stream.withColumn("after_updates", F.col("parameter").isNull().cast("int"))
    out = ", ".join(["event_id BIGINT", *[f"{n} DOUBLE" for n in order]])
    return fold(marked, keys, ["t", "after_updates", "sequence"], out, "values STRING", (json.dumps(names),), step)


def windowed_counts(stream: DataFrame, ts: str, width: str, delay: str, marks: Sequence[str]) -> DataFrame:
    """Counts per regular window, emitted once the watermark has passed it."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, width))
    got = w.agg(*[F.count_if(F.col("mark") == m).alias(f"n_{m}") for m in marks])
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[f"n_{m}" for m in marks])


def split_by_status(df: DataFrame, accepted: Sequence[str], column: str = "status") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejects of a stream or a batch."""
    ok = F.col(column).isin(*accepted)
    return df.filter(ok), df.filter(~ok)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into Parquet under ``path`` and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
