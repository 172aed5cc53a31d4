"""Outage inference over every prefix of a series.

Whether a prefix of ``n`` values is available depends on the largest running sum of drops below the mean ``m`` of its
first half: the maximum over ``i <= j <= n`` of ``(j - i)(m - k) - (S_j - S_i)`` with prefix sums ``S``.  The mean moves
with every row, but for a fixed stretch of rows the maximum is a convex, piecewise linear function of ``c = m - k``, so a
stretch is summed up by three hulls: of where a window may start, of where it may end, and of the windows inside.
Stretches next to each other merge, windows that cross the seam being a Minkowski sum of starts on the left and ends on
the right.  A prefix is then a few merged stretches, asked at one ``c``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ordered
from ..ordered import rnumber, rsum
from ..session import cut
from .adaptive import CUSUM_H, CUSUM_K, DROP_THRESHOLD, UP_LEVEL

Points = list[tuple[float, float]]
#: (starts, ends, windows): an upper hull and two lower hulls
Hulls = tuple[Points, Points, Points]
#: rows of one key that one task sums up
BLOCK = 1 << 16


def lower_hull(points: Iterable[tuple[float, float]], sign: float = 1.0) -> Points:
    """The lower hull of points sorted by x, or with ``sign`` -1 the upper one."""
    out: Points = []
    for x, y in points:
        if out and out[-1][0] == x:
            if sign * y >= sign * out[-1][1]:
                continue
            out.pop()
        while len(out) > 1 and sign * (out[-1][1] - out[-2][1]) * (x - out[-1][0]) >= sign * (y - out[-1][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append((x, y))
    return out


def largest(hull: Points, c: float, sign: float = 1.0) -> float:
    """The maximum of ``sign * (c x - y)`` over a hull."""
    low, high = 0, len(hull) - 1
    while low < high:
        middle = (low + high) // 2
        (x, y), (x2, y2) = hull[middle], hull[middle + 1]
        if sign * (c * (x2 - x) - (y2 - y)) >= 0:
            low = middle + 1
        else:
            high = middle
    x, y = hull[low]
    return sign * (c * x - y)


def minkowski(a: Points, b: Points) -> Points:
    """The lower hull of all sums of a point of either lower hull: their edges by rising slope."""
    i = j = 0
    out = [(a[0][0] + b[0][0], a[0][1] + b[0][1])]
    while i + 1 < len(a) or j + 1 < len(b):
        if j + 1 == len(b):
            first = True
        elif i + 1 == len(a):
            first = False
        else:
            first = (a[i + 1][1] - a[i][1]) * (b[j + 1][0] - b[j][0]) <= (b[j + 1][1] - b[j][1]) * (a[i + 1][0] - a[i][0])
        i, j = (i + 1, j) if first else (i, j + 1)
        out.append((a[i][0] + b[j][0], a[i][1] + b[j][1]))
    return out


def point(n: int, total: float) -> Hulls:
    """The stretch of one place: after ``n`` rows that sum up to ``total``."""
    return [(n, total)], [(n, total)], [(0, 0.0)]


def merge(left: Hulls, right: Hulls) -> Hulls:
    starts = lower_hull(left[0] + right[0], -1.0)
    ends = lower_hull(left[1] + right[1])
    across = minkowski(right[1], [(-x, -y) for x, y in reversed(left[0])])
    return starts, ends, lower_hull(sorted(left[2] + right[2] + across))


def largest_drop(stretches: Iterable[Hulls], c: float) -> float:
    """The largest window over stretches that follow each other."""
    best, start = 0.0, -float("inf")
    for starts, ends, windows in stretches:
        best = max(best, largest(windows, c), largest(ends, c) + start)
        start = max(start, largest(starts, c, -1.0))
    return best


def decided(x: float, drop: float = DROP_THRESHOLD) -> bool | None:
    """Availability where the last value alone tells."""
    return False if x <= 0 or x < min(drop, UP_LEVEL) else True if x >= UP_LEVEL else None


class Levels(dict[int, tuple[Hulls | None]]):
    """Stretches of 1, 2, 4, ... rows in memory, with the calls of a state store's map."""

    def getValue(self, key: tuple[int]) -> tuple[Any] | None:
        return self.get(key[0])

    def updateValue(self, key: tuple[int], value: tuple[Any]) -> None:
        self[key[0]] = value

    def removeKey(self, key: tuple[int]) -> None:
        del self[key[0]]


def add_row(n: int, total: float, x: float, mean: float, levels: Any, before: Sequence[Hulls] = (), first: int = 0, k: float = CUSUM_K, h: float = CUSUM_H, drop: float = DROP_THRESHOLD) -> bool:
    """Add row ``n`` (from 1) with value ``x`` to the stretches and tell whether the prefix that ends in it is available.

    ``levels`` holds a stretch of ``2 ** level`` rows for each bit of the rows after ``first``; adding one carries as in
    counting.  ``mean`` is that of the first half of the prefix and ``before`` what lies before ``first``.
    """
    # text gives lists back
    load = lambda hulls: hulls if isinstance(hulls, tuple) else tuple([tuple(p) for p in hull] for hull in hulls)
    new, count, level = point(n, total), n - first - 1, 0
    while count >> level & 1:
        new = merge(load(levels.getValue((level,))[0]), new)
        levels.removeKey((level,))
        level += 1
    levels.updateValue((level,), (new,))
    known = decided(x, drop)
    if known is not None:
        return known
    count += 1
    stretches = [load(levels.getValue((b,))[0]) for b in range(count.bit_length() - 1, -1, -1) if count >> b & 1]
    start = before if first or before else [point(0, 0.0)]
    return largest_drop([*start, *stretches], mean - k) <= h


def _hulls(text: str) -> Hulls:
    return tuple([tuple(p) for p in hull] for hull in json.loads(text))


def outage_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, drop: float = DROP_THRESHOLD, k: float = CUSUM_K, h: float = CUSUM_H, block: int = BLOCK) -> DataFrame:
    """``keys, order, available`` for every row: what the detector says of the series that ends in it.

    Rows of a key are summed up in blocks of ``block`` rows; blocks learn what lies before them from one summary a block,
    and evaluate their own rows with it, so a long series is many tasks.  A null value counts as no drop and no rise: the
    row repeats what holds before it.
    """
    keys, order = list(keys), list(order)
    x = F.col(value).cast("double")
    rows = ordered.scan(df.filter(x.isNotNull()).select(*keys, *order, x.alias("_x")), keys, order, {"_n": rnumber(), "_total": rsum("_x")})
    rows = cut(rows.withColumn("_half", F.greatest(F.lit(1), F.floor(F.col("_n") / 2))))
    halves = rows.select(*keys, F.col("_n").alias("_half"), F.col("_total").alias("_before"))
    placed = rows.join(halves, [*keys, "_half"]).withColumn("_mean", F.col("_before") / F.col("_half")).withColumn("_block", F.floor((F.col("_n") - 1) / block))
    placed = cut(placed.select(*keys, *order, "_x", "_n", "_total", "_mean", "_block"))
    types = dict(placed.dtypes)
    part = [*keys, "_block"]
    fields = ", ".join(f"`{c}` {types[c]}" for c in part)

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        level: list[Hulls] = [point(n, t) for n, t in pdf.sort_values("_n")[["_n", "_total"]].itertuples(index=False, name=None)]
        while len(level) > 1:
            level = [merge(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pd.DataFrame([(*key, json.dumps(level[0]))], columns=[*part, "hulls"])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, left = [], point(0, 0.0)
        for number, text in pdf.sort_values("_block")[["_block", "hulls"]].itertuples(index=False, name=None):
            out.append((*key, number, json.dumps(left)))
            left = merge(left, _hulls(text))
        return pd.DataFrame(out, columns=[*part, "hulls"])

    def judge(key: tuple, pdf: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        before = [_hulls(left["hulls"].iloc[0]) if len(left) else point(0, 0.0)]
        pdf = pdf.sort_values("_n")
        first, levels = int(pdf["_n"].iloc[0]) - 1, Levels()
        said = [add_row(n, t, v, m, levels, before, first, k, h, drop) for n, t, v, m in pdf[["_n", "_total", "_x", "_mean"]].itertuples(index=False, name=None)]
        return pdf[[*keys, *order]].assign(available=said)

    # only keys of several blocks need summaries
    long = placed.filter("_block > 0").select(*keys).distinct()
    same = None
    for c in keys:
        hit = F.col(c).eqNullSafe(F.col(f"_long_{c}"))
        same = hit if same is None else same & hit
    marks = long.select(*[F.col(c).alias(f"_long_{c}") for c in keys])
    whole = placed.join(marks, same, "left_semi") if keys else placed.join(long.limit(1), how="left_semi")
    summed = cut(whole.groupBy(*part).applyInPandas(summary, f"{fields}, hulls string"))
    lefts = cut(summed.groupBy(*keys).applyInPandas(chain, f"{fields}, hulls string"))
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*keys, *order]] + ["available boolean"])
    judged = placed.groupBy(*part).cogroup(lefts.groupBy(*part)).applyInPandas(judge, schema)
    if df.filter(x.isNull()).isEmpty():
        return judged
    both = judged.unionByName(df.filter(x.isNull()).select(*keys, *order, F.lit(None).cast("boolean").alias("available")))
    return ordered.scan(both, keys, order, {"_last": ordered.rlast("available")}).withColumn("available", F.col("_last")).drop("_last")
