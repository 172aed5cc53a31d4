"""Ordered recursive statistics and parameter constraints.

EMA, eligibility traces and Robbins-Monro are linear recurrences and CUSUM is a
running sum against its running minimum, so all of them are prefix scans.  They
go through :mod:`hyperlake.ordered` and a single long series is split across
tasks.  Recurrences with decay are rescaled inside blocks, so no power of the
decay factor can overflow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ordered
from ..ordered import rlag, rmin, rnumber, rsum
from ..session import cut

# fixed values: smoothing defaults, detector thresholds, the alpha search grid
EMA_ALPHA = 0.35
DROP_THRESHOLD, CUSUM_K, CUSUM_H = 0.45, 0.15, 1.25
UP_LEVEL = 0.99
ALPHA_GRID = tuple(round(0.05 + 0.05 * i, 2) for i in range(18))
SMALLEST_NORMAL = 2.2250738585072014e-308

# a block spans at most this much log decay: exp(600) is still a finite double
_BLOCK = 600.0


def linear_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], log_decay: str, impulse: str, out: str, per_row: bool = False) -> DataFrame:
    """z_i = exp(-(g_i - g_{i-1})) z_{i-1} + x_i for a running log decay g (non-decreasing).

    Inside a block of bounded decay z_i = exp(-(g_i - G)) * sum_j exp(g_j - G) x_j,
    with G the start of the block.  Block results are chained the same way over
    blocks, where a block more than one apart has decayed below double precision.
    With ``per_row`` the decay is a fixed amount per row, so a block holds a bounded
    number of rows and is never split further.
    """
    keys = list(keys)
    g = F.col(log_decay)
    b = df.withColumn("_blk", F.floor(g / _BLOCK).cast("long"))
    b = b.withColumn("_x", F.exp(g - F.col("_blk") * _BLOCK) * F.col(impulse))
    scan = ordered.running if per_row else ordered.scan
    local = scan(b, [*keys, "_blk"], order, {"_s": rsum("_x")})
    # contribution of the previous block, seen from the start of this one
    ends = b.groupBy(*keys, "_blk").agg(F.sum("_x").alias("_e"))
    prev = ends.select(*keys, (F.col("_blk") + 1).alias("_blk"), (F.col("_e") * F.exp(F.lit(-_BLOCK))).alias("_in"))
    joined = local.join(prev, [*keys, "_blk"], "left")
    z = F.exp(-(g - F.col("_blk") * _BLOCK)) * (F.col("_s") + F.coalesce("_in", F.lit(0.0)))
    return joined.withColumn(out, z).drop("_blk", "_x", "_s", "_in")


def eligibility_trace(df: DataFrame, keys: Sequence[str], t: str, impulse: str, tau: float, out: str = "trace", initial: float = 0.0, ties: Sequence[str] = ()) -> DataFrame:
    """z <- z * exp(-dt / tau) + impulse, evaluated at every event of a key.

    Events at one time follow in the order of ``ties``, then of the impulse, so running values are the same in every run.
    """
    if not tau > 0:
        raise ValueError("tau must be positive")
    order = [t, *ties, impulse]
    first = df.groupBy(*keys).agg(F.min(t).alias("_t0"))
    base = df.join(first, list(keys)).withColumn("_g", (F.col(t) - F.col("_t0")) / tau)
    if initial:
        got = linear_scan(base, keys, order, "_g", impulse, out)
        got = got.withColumn(out, F.col(out) + F.lit(initial) * F.exp(-F.col("_g")))
    else:
        got = linear_scan(base, keys, order, "_g", impulse, out)
    return got.drop("_t0", "_g")


def ema_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = EMA_ALPHA, out: str = "ema") -> DataFrame:
    """Exponential smoothing; the first value of a series seeds it."""
    if not 0 < alpha <= 1:
        raise ValueError("a smoothing weight lies above 0 and at most at 1")
    if alpha == 1:
        return df.withColumn(out, F.col(value).cast("double"))
    n = ordered.scan(df, keys, order, {"_i": rnumber()})
    n = n.withColumns({
        "_g": (F.col("_i") - 1) * F.lit(-_ln(1 - alpha)),
        "_imp": F.when(F.col("_i") == 1, F.col(value).cast("double")).otherwise(F.lit(alpha) * F.col(value)),
    })
    return linear_scan(n, keys, order, "_g", "_imp", out, per_row=True).drop("_i", "_g", "_imp")


def _ln(x: float) -> float:
    import math

    return math.log(x)


def load_level(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = EMA_ALPHA, capacity: int = 6) -> DataFrame:
    """Smoothed value at the end of each series and its load clip(round(ema), 0, capacity)."""
    s = ema_series(df, keys, order, value, alpha, "_e")
    last = s.groupBy(*keys).agg(F.max_by("_e", F.struct(*order)).alias("smoothed"))
    load = F.greatest(F.lit(0), F.least(F.lit(capacity), F.bround("smoothed"))).cast("int")
    return last.withColumn("load", load)


def fit_ema_alpha(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, grid: Sequence[float] = ALPHA_GRID, default: float = EMA_ALPHA) -> DataFrame:
    """Alpha of least one-step-ahead squared error per series, the smaller on ties.

    Rows are numbered once and cut into blocks short enough for the fastest decay.  In a block the prediction is a part
    of its own rows plus (1 - alpha)^row times the level at its start, so sums of squares per (block, alpha) leave the
    rows, and only blocks, one row each, are multiplied by the grid and chained.
    """
    keys = list(keys)
    rows = ordered.measured(df.select(*keys, *order, F.col(value).cast("double").alias("_y")), keys, order)
    rows = ordered.unmarked(ordered.scan(rows, keys, order, {"_i": rnumber()}))
    decays = [-_ln(1 - float(a)) for a in grid]
    size = max(1, int(_BLOCK / max(decays)))
    rows = rows.withColumns({"_part": F.floor((F.col("_i") - 1) / size), "_at": (F.col("_i") - 1) % size})
    before = Window.partitionBy(*keys, "_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    # until its first value a series has no level
    rows = rows.withColumn("_seen", F.count("_y").over(before))
    y, at = F.col("_y"), F.col("_at")
    gain = lambda j: F.exp(at * F.lit(decays[j])) * F.when(F.col("_i") == 1, y).otherwise(F.lit(float(grid[j])) * y)
    rows = rows.withColumns({f"_s{j}": F.sum(gain(j)).over(before) for j in range(len(grid))})
    cells = []
    for j, a in enumerate(grid):
        left = F.exp(-at * F.lit(decays[j]))
        own = F.coalesce(F.col(f"_s{j}"), F.lit(0.0)) * F.exp(-(at - 1) * F.lit(decays[j])) - y
        cells.append(F.struct(
            F.lit(float(a)).alias("alpha"), F.lit(decays[j]).alias("d"), F.sum(gain(j)).alias("z"),
            F.sum(F.when(F.col("_seen") > 0, own * own)).alias("uu0"), F.sum(own * own).alias("uu"), F.sum(F.when(y.isNotNull(), own * left)).alias("uw"), F.sum(F.when(y.isNotNull(), left * left)).alias("ww")))
    per = rows.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("n"), F.count("_y").alias("m"), F.count_if((F.col("_seen") > 0) & y.isNotNull()).alias("m0"), F.array(*cells).alias("_c"))
    each = per.select(*keys, "_part", "n", "m", "m0", F.inline("_c"))
    # level at the end of a full block, and with it the start of the next
    each = each.withColumns({"_g": F.col("_part") * F.col("d") * size, "_z": F.col("z") * F.exp(-F.col("d") * (size - 1))})
    each = ordered.measured(cut(each), [*keys, "alpha"], ["_part"])
    each = linear_scan(each, [*keys, "alpha"], ["_part"], "_g", "_z", "_e", per_row=True)
    each = ordered.scan(each, [*keys, "alpha"], ["_part"], {"_in": rlag("_e")})
    c = F.col("_in")
    whole = F.col("uu") + 2 * c * F.col("uw") + c * c * F.col("ww")
    sq, m = F.when(c.isNull(), F.col("uu0")).otherwise(whole), F.when(c.isNull(), F.col("m0")).otherwise(F.col("m"))
    err = each.groupBy(*keys, "alpha").agg((F.sum(sq) / F.nullif(F.sum(m), F.lit(0))).alias("mse"), F.sum("n").alias("n"))
    best = err.groupBy(*keys).agg(F.min(F.struct("mse", "alpha")).alias("_b"), F.max("n").alias("n"))
    return best.select(*keys, F.when(F.col("n") < 3, F.lit(default)).otherwise(F.col("_b.alpha")).alias("alpha"), F.col("_b.mse").alias("mse"), "n")


def robbins_monro(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, rate: float, initial: float = 0.0, out: str = "theta") -> DataFrame:
    """theta <- theta + rate * error, evaluated at every row."""
    if not rate > 0:
        raise ValueError("the learning rate must be positive")
    got = ordered.scan(df, keys, order, {"_s": rsum(error)})
    return got.withColumn(out, F.lit(float(initial)) + F.lit(float(rate)) * F.col("_s")).drop("_s")


def cusum_outage(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, drop: float = DROP_THRESHOLD, k: float = CUSUM_K, h: float = CUSUM_H) -> DataFrame:
    """Availability of each series from its last value, or a CUSUM of drops.

    With d_i = mean_first_half - x_i - k the accumulator max(0, acc + d) equals the
    running sum minus its running minimum (zero included), so the detector is two
    prefix scans and one maximum.
    """
    keys = list(keys)
    rows = ordered.measured(df.select(*keys, *order, F.col(value).cast("double").alias("_x")), keys, order)
    rows = ordered.scan(rows, keys, order, {"_i": rnumber()})
    n = rows.groupBy(*keys).agg(F.max("_i").alias("_n"), F.max_by("_x", "_i").alias("last"))
    rows = rows.join(n, keys)
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    mean = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_i") <= half, F.col("_x"))).alias("_m"))
    d = rows.join(mean, keys).withColumn("_d", -(F.col("_x") - F.col("_m") + F.lit(k)))
    p = ordered.scan(d, keys, order, {"_p": rsum("_d")})
    low = ordered.scan(p, keys, order, {"_low": rmin("_p")})
    top = low.groupBy(*keys).agg(F.max("last").alias("last"), F.max(F.col("_p") - F.least(F.col("_low"), F.lit(0.0))).alias("cusum"))
    up = F.when(F.col("last") <= 0, False).when(F.col("last") >= UP_LEVEL, True).when(F.col("last") < drop, False).otherwise(F.col("cusum") <= h)
    return top.withColumn("available", up)


def prefix_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "prefix_mean") -> DataFrame:
    """Mean of every prefix of a series."""
    got = ordered.scan(df, keys, order, {"_s": rsum(value), "_i": rnumber()})
    return got.withColumn(out, F.col("_s") / F.col("_i")).drop("_s", "_i")


def valid(x: Column, constraint: str, lower: float | None = None, upper: float | None = None) -> Column:
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rule = {
        "free": F.lit(True), "positive": finite & (x > 0), "nonnegative": finite & (x >= 0), "probability": finite & (x >= 0) & (x <= 1),
    }.get(constraint)
    if rule is None:
        if constraint != "bounded" or lower is None or upper is None or lower > upper:
            raise ValueError("bounded parameters require lower <= upper")
        rule = finite & (x >= lower) & (x <= upper)
    return rule


def project(x: Column, constraint: str, policy: str = "strict", lower: float | None = None, upper: float | None = None) -> Column:
    """STRUCT<value, rejected>: STRICT rejects an invalid value, PROJECT clips it."""
    ok = valid(x, constraint, lower, upper)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    if policy == "strict":
        return F.struct(F.when(ok, x).alias("value"), (~ok).alias("rejected"))
    clipped = {
        "free": x, "positive": F.greatest(x, F.lit(SMALLEST_NORMAL)), "nonnegative": F.greatest(F.lit(0.0), x),
        "bounded": F.least(F.greatest(x, F.lit(lower)), F.lit(upper)), "probability": F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)),
    }[constraint]
    return F.struct(F.when(ok, x).when(finite, clipped).alias("value"), (~ok & ~finite).alias("rejected"))


def scheduled_assignments(events: DataFrame, updates: DataFrame, keys: Sequence[str], names: Mapping[str, float]) -> DataFrame:
    """Parameter values in force at every event: the latest scheduled update at or before it.

    ``updates``: keys, t, sequence, parameter, value; ``names`` maps each parameter
    to its initial value.  One union and one running scan serve all parameters.
    """
    wide = updates.groupBy(*keys, "t", "sequence").agg(*[F.max_by(F.when(F.col("parameter") == p, F.col("value")), F.when(F.col("parameter") == p, F.lit(1))).alias(f"_{p}") for p in names])
    u = wide.withColumn("_kind", F.lit(0))
    e = events.withColumn("_kind", F.lit(1))
    both = u.unionByName(e, allowMissingColumns=True)
    both = both.withColumn("sequence", F.coalesce("sequence", F.lit(0)))
    got = ordered.scan(both, keys, ["t", "_kind", "sequence"], {f"_v_{p}": ordered.rlast(f"_{p}") for p in names})
    cols = {p: F.coalesce(F.col(f"_v_{p}"), F.lit(float(v))) for p, v in names.items()}
    return got.filter("_kind = 1").withColumns(cols).select(*events.columns, *names)
