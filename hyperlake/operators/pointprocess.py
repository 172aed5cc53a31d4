"""Marked point processes observed on irregular intervals.

Tables: observations (trace, t), marks (trace, t, mark) and, per interval and
mark, rates.  Binning, compensators and overlaps are prefix scans over the union
of both time lines, so nothing is range-joined and one long trace is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ordered
from ..ordered import rlag, rlast, rlead, rnumber, rsum
from ..session import cut
from . import bootstrap as boot
from .bootstrap import hashed

TRACE = ("trace",)
RATE_FLOOR, RATE_CAP = 1e-6, 30.0
LOG_FLOOR = 1e-8


def interval_dt(obs: DataFrame, horizon: float, keys: Sequence[str] = TRACE) -> DataFrame:
    """Exposure until the next observation or the horizon, and the interval index."""
    got = ordered.scan(obs, keys, ["t"], {"_n": rnumber(), "_next": rlead("t", float(horizon))})
    return got.select(*[c for c in got.columns if c not in ("_n", "_next")], (F.col("_n") - 1).alias("i"), (F.col("_next") - F.col("t")).alias("dt"))


def nonpositive_exposure(intervals: DataFrame) -> DataFrame:
    return intervals.filter(~(F.col("dt") > 0))


def as_of_interval(obs: DataFrame, events: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    """Index i of the interval [t_i, t_{i+1}) each event falls in; earlier events are dropped."""
    o = obs.select(*keys, "t", F.lit(0).alias("_o"))
    e = events.withColumn("_o", F.lit(1))
    both = o.unionByName(e, allowMissingColumns=True)
    got = ordered.scan(both, keys, ["t", "_o"], {"_i": rsum(F.when(F.col("_o") == 0, 1).otherwise(0))})
    return got.filter("_o = 1 AND _i > 0").withColumn("i", F.col("_i") - 1).select(*events.columns, "i")


def build_intervals(obs: DataFrame, events: DataFrame, marks: Sequence[str], horizon: float, keys: Sequence[str] = TRACE) -> DataFrame:
    """One row per interval: i, t, dt, n_<mark> counts and causal lag features.

    Observations open intervals and events fall into the open one, so a single
    running count over the union numbers both and one grouping yields the counts.
    """
    o = obs.select(*keys, "t", F.lit(0).alias("_o"), F.lit(None).cast("string").alias("mark"))
    e = events.select(*keys, "t", F.lit(1).alias("_o"), "mark")
    # several observations or events at one instant keep their kind order
    both = ordered.measured(o.unionByName(e), keys, ["t", "_o"])
    got = ordered.scan(both, keys, ["t", "_o"], {"_i": rsum(F.when(F.col("_o") == 0, 1).otherwise(0))})
    per = got.filter("_i > 0").groupBy(*keys, (F.col("_i") - 1).alias("i")).agg(
        F.min(F.when(F.col("_o") == 0, F.col("t"))).alias("t"), *[F.count_if(F.col("mark") == m).alias(f"n_{m}") for m in marks]
    )
    if ordered.WHOLE in both.columns:
        # a key has no more intervals than observations and events
        per = per.withColumn(ordered.WHOLE, F.lit(True))
    nxt = ordered.scan(per, keys, ["t"], {"_next": rlead("t", float(horizon))})
    nxt = nxt.withColumn("dt", F.col("_next") - F.col("t")).drop("_next")
    return ordered.unmarked(lag_features(nxt, marks, keys))


def lag_features(intervals: DataFrame, marks: Sequence[str], keys: Sequence[str] = TRACE) -> DataFrame:
    """Previous interval's event rate of the first mark and counts of the others; first row 0."""
    first, rest = marks[0], marks[1:]
    got = ordered.scan(intervals, keys, ["t"], {"_dt": rlag("dt"), **{f"_l_{m}": rlag(f"n_{m}", 0) for m in marks}})
    rate = F.coalesce(F.col(f"_l_{first}") / F.greatest(F.col("_dt"), F.lit(1e-6)), F.lit(0.0))
    out = got.withColumn(f"lag_rate_{first}", rate).withColumns({f"lag_n_{m}": F.col(f"_l_{m}") for m in rest})
    return out.drop("_dt", *[f"_l_{m}" for m in marks])


def long_counts(intervals: DataFrame, marks: Sequence[str], keys: Sequence[str] = TRACE) -> DataFrame:
    """trace, i, t, dt, mark, n: unfolded locally, no shuffle."""
    rows = F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"n_{m}").alias("n")) for m in marks])
    return intervals.select(*keys, "i", "t", "dt", F.inline(rows))


def constant_rates(counts: DataFrame, by: Sequence[str] = ("mark",)) -> DataFrame:
    """Homogeneous baseline: (events + 1e-6) / max(exposure, 1e-9) per mark."""
    return counts.groupBy(*by).agg(((F.sum("n") + 1e-6) / F.greatest(F.sum("dt"), F.lit(1e-9))).alias("rate"))


def constant_baseline(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """The fitted rate on every interval; ``rates`` has one row per mark."""
    return counts.join(rates, "mark")


def clip_rates(rate: Column, low: float = RATE_FLOOR, high: float = RATE_CAP) -> Column:
    return F.least(F.greatest(rate, F.lit(low)), F.lit(high))


def clip_audit(rates: DataFrame, keys: Sequence[str], trace: Sequence[str] = TRACE) -> DataFrame:
    """Values above 20 and 30, maximum and largest per-trace 99.9 % quantile."""
    keys = list(keys)
    per = rates.groupBy(*keys, *trace).agg(
        F.count("rate").alias("values"), F.count_if(F.col("rate") > 20).alias("above_20"), F.count_if(F.col("rate") > 30).alias("above_30"), F.max("rate").alias("max_rate"),
    )
    q = ordered.quantiles(rates, [*keys, *trace], "rate", {"p999": 0.999})
    got = per.join(q, [*keys, *trace]).groupBy(*keys).agg(
        F.sum("values").alias("values"), F.sum("above_20").alias("above_20"), F.sum("above_30").alias("above_30"),
        F.max("max_rate").alias("max_rate"), F.max("p999").alias("p999_rate"),
    )
    return got.withColumns({"fraction_above_20": F.col("above_20") / F.col("values"), "fraction_above_30": F.col("above_30") / F.col("values")})


def nll_term() -> Column:
    """rate * dt - n * log(max(rate, 1e-8)) of one interval and mark."""
    return F.col("rate") * F.col("dt") - F.col("n") * F.log(F.greatest(F.col("rate"), F.lit(LOG_FLOOR)))


def nll(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total negative log-likelihood with its per-interval and per-event means."""
    cells = rates.groupBy(*keys, *TRACE, "i").agg(F.sum(nll_term()).alias("_l"), F.sum("n").alias("_n"))
    got = cells.groupBy(*keys).agg(F.sum("_l").alias("nll"), F.count(F.lit(1)).alias("intervals"), F.sum("_n").alias("events"))
    return got.withColumns({"nll_per_interval": F.col("nll") / F.greatest("intervals", F.lit(1)), "nll_per_event": F.col("nll") / F.greatest("events", F.lit(1))})


def rate_error(rates: DataFrame, keys: Sequence[str], true: str = "true_rate") -> DataFrame:
    """MAE, RMSE and Spearman correlation of predicted against true rates."""
    e = F.col("rate") - F.col(true)
    base = rates.groupBy(*keys).agg(F.avg(F.abs(e)).alias("rate_mae"), F.sqrt(F.avg(e * e)).alias("rate_rmse"))
    return boot._attach(base, boot.spearman(rates, "rate", true, keys).withColumnRenamed("rank_corr", "rate_spearman"), list(keys))


def count_ratio(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected over observed counts, per mark and in total (mark null)."""
    got = rates.groupingSets([[*keys, "mark"], [*keys]], *keys, "mark").agg(
        F.sum(F.col("rate") * F.col("dt")).alias("expected"), F.sum("n").alias("observed")
    )
    return got.withColumn("ratio", F.col("expected") / F.greatest(F.col("observed").cast("double"), F.lit(1e-9)))


def observed_over_expected(rates: DataFrame, split: str) -> DataFrame:
    return rates.groupBy(split, "mark").agg((F.sum("n") / F.greatest(F.sum(F.col("rate") * F.col("dt")), F.lit(1e-9))).alias("observed_over_expected"))


def normalizer(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: mean and population sd, sd below 1e-6 replaced by 1."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    got = df.select(F.inline(rows)).groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return got.withColumn("sd", F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")))


def normalize(df: DataFrame, features: Sequence[str], fitted: DataFrame) -> DataFrame:
    """(x - mean) / sd; the fitted table is folded into one row, one entry per feature."""
    one = fitted.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "sd")))).alias("_f")).withColumn("_k", F.lit(1))
    got = df.withColumn("_k", F.lit(1)).join(one, "_k")
    return got.withColumns({f: (F.col(f) - F.col("_f")[f]["mean"]) / F.col("_f")[f]["sd"] for f in features}).drop("_k", "_f")


def compensator_increments(rates: DataFrame, events: DataFrame, horizon: float, keys: Sequence[str] = TRACE, model: Sequence[str] = ()) -> DataFrame:
    """Integral of the predicted rate between successive events of a mark.

    The cumulative integral at an event is the value at the latest interval start
    plus rate times elapsed time; increments are its differences, the first event
    of a trace omitted.  The first interval's rate also covers times before it.
    """
    line = [*model, *keys, "mark"]
    r = rates.select(*line, "t", "rate", "dt")
    # read three times below, so written once
    r = cut(ordered.scan(cut(r), line, ["t"], {"_cum": rsum(F.col("rate") * F.col("dt"), inclusive=False)}))
    at = r.select(*line, "t", F.lit(0).alias("_o"), F.struct(F.col("_cum").cast("double").alias("c"), F.col("rate").alias("r"), F.col("t").alias("s")).alias("_p"))
    head = at.groupBy(*line).agg(F.min_by("_p", "t").alias("_first"))
    e = events.select(*keys, "mark", "t").filter(F.col("t") > 1e-12).distinct()
    if model:
        e = e.join(r.select(*line).distinct(), [*keys, "mark"])
    e = e.select(*line, "t", F.lit(1).alias("_o"), F.lit(None).cast(at.schema["_p"].dataType).alias("_p"))
    got = ordered.scan(at.unionByName(e), line, ["t", "_o"], {"_q": rlast("_p")}).filter("_o = 1").join(head, line)
    p = F.coalesce("_q", "_first")
    got = got.withColumn("_v", p["c"] + p["r"] * (F.least(F.col("t"), F.lit(float(horizon))) - p["s"]))
    inc = ordered.scan(cut(got.select(*line, "t", "_v")), line, ["t"], {"_prev": rlag("_v")})
    return inc.filter("_prev IS NOT NULL").select(*line, "t", (F.col("_v") - F.col("_prev")).alias("increment"))


def interval_overlaps(spans: DataFrame, intervals: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    """Overlap length of each span (span_id, start, end) with each interval (i, t).

    Spans of a key follow each other without gaps, as do intervals.  Cutting the
    line at all their starts gives pieces that lie in one span and one interval.
    """
    s = spans.select(*keys, F.col("start").alias("t"), "span_id", F.lit(None).cast("bigint").alias("i"))
    tail = spans.groupBy(*keys).agg(F.max("end").alias("_end"))
    v = intervals.select(*keys, "t", F.lit(None).cast(dict(spans.dtypes)["span_id"]).alias("span_id"), F.col("i").cast("bigint").alias("i"))
    cuts = s.unionByName(v).groupBy(*keys, "t").agg(F.max("span_id").alias("span_id"), F.max("i").alias("i"))
    got = ordered.scan(cuts, keys, ["t"], {"_s": rlast("span_id"), "_i": rlast("i"), "_next": rlead("t")}).join(tail, list(keys))
    piece = F.least(F.coalesce("_next", "_end"), F.col("_end")) - F.col("t")
    return (
        got.filter("_s IS NOT NULL AND _i IS NOT NULL").withColumn("overlap", piece).filter("overlap > 0")
        .groupBy(*keys, F.col("_s").alias("span_id"), F.col("_i").alias("i")).agg(F.sum("overlap").alias("overlap"))
    )


def ks_uniform(increments: DataFrame, keys: Sequence[str], value: str = "increment", minimum: int = 8) -> DataFrame:
    """Distance of 1 - exp(-x) from uniform with its asymptotic p-value; null below ``minimum`` rows."""
    keys = list(keys)
    u = increments.select(*keys, (1 - F.exp(-F.col(value))).alias("u"))
    # equal values are counted first; the distance only changes at distinct values
    c = u.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("_c"))
    cum = ordered.scan(c, keys, ["u"], {"_before": rsum("_c", inclusive=False)})
    size = c.groupBy(*keys).agg(F.sum("_c").alias("n"))
    got = boot._attach(cum, size, keys)
    n = F.col("n")
    d = got.groupBy(*keys).agg(F.max(F.greatest((F.col("_before") + F.col("_c")) / n - F.col("u"), F.col("u") - F.col("_before") / n)).alias("ks"), F.max("n").alias("n"))
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("ks")
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * lam * lam))
    enough = F.col("n") >= minimum
    return d.select(*keys, "n", F.when(enough, F.col("ks")).alias("ks"), F.when(enough, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).alias("p"))


def sparsify_flags(intervals: DataFrame, keep_probability: float, seed: int, keys: Sequence[str] = TRACE) -> DataFrame:
    """Deterministic keep flag per interval; the first is kept and at least two are."""
    if not 0 < keep_probability <= 1:
        raise ValueError("a share to keep lies above 0 and at most at 1")
    ident = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    lucky = hashed(F.lit(seed), ident, F.col("i")) / 4294967296.0 < keep_probability
    flagged = intervals.withColumn("keep", (F.col("i") == 0) | lucky | F.lit(keep_probability >= 1))
    per = flagged.groupBy(*keys).agg(F.count_if("keep").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    spare = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    got = flagged.join(per, list(keys))
    return got.withColumn("keep", F.col("keep") | ((F.col("_kept") < 2) & (F.col("i") == spare))).drop("_kept", "_n")


def merge_intervals(flagged: DataFrame, marks: Sequence[str], rates: Sequence[str] = (), keys: Sequence[str] = TRACE) -> DataFrame:
    """Fold every dropped interval into the last kept one: counts summed, rates exposure-weighted."""
    got = ordered.scan(flagged, keys, ["t"], {"_g": rsum(F.col("keep").cast("int"))})
    return got.groupBy(*keys, (F.col("_g") - 1).alias("i")).agg(
        F.min("t").alias("t"), F.sum("dt").alias("dt"), *[F.sum(f"n_{m}").alias(f"n_{m}") for m in marks],
        *[(F.sum(F.col(r) * F.col("dt")) / F.sum("dt")).alias(r) for r in rates],
    )


def sparsify_trace(intervals: DataFrame, marks: Sequence[str], keep_probability: float, seed: int, rates: Sequence[str] = (), keys: Sequence[str] = TRACE) -> DataFrame:
    """Sparse view of a trace: totals and horizon kept, lag features recomputed."""
    flagged = sparsify_flags(intervals, keep_probability, seed, keys)
    return lag_features(merge_intervals(flagged, marks, rates, keys), marks, keys)


def evaluate_rates(rates: DataFrame, events: DataFrame, horizon: float, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One row per model: likelihood, rate errors, count ratio and time-rescaling distances."""
    keys = list(keys)
    rates = cut(rates)
    base = nll(rates, keys).join(rate_error(rates, keys), keys)
    total = rates.groupBy(*keys).agg((F.sum(F.col("rate") * F.col("dt")) / F.greatest(F.sum("n").cast("double"), F.lit(1e-9))).alias("count_ratio"))
    inc = compensator_increments(rates, events, horizon, model=keys)
    ks = ks_uniform(inc, [*keys, "mark"]).groupBy(*keys).agg(F.max("ks").alias("worst_ks"), F.min("p").alias("worst_p"))
    return base.join(total, keys).join(ks, keys, "left")


def paired_nll(rates: DataFrame, a: str, b: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Per-trace NLL difference of two models with its interval and better-share."""
    per = rates.groupBy("model", *TRACE).agg((F.sum(nll_term()) / F.count_distinct("i")).alias("_l"))
    wide = per.groupBy(*TRACE).agg(F.max(F.when(F.col("model") == a, F.col("_l"))).alias("_a"), F.max(F.when(F.col("model") == b, F.col("_l"))).alias("_b"))
    d = wide.withColumn("d", F.col("_a") - F.col("_b")).filter("d IS NOT NULL")
    got = boot.bootstrap_mean(d, "d", [], list(TRACE), draws, seed)
    share = boot.better_fraction(d, "d").select("better_fraction")
    return boot._attach(got, share, [])


def windowed_counts(events: DataFrame, ts: str, width: str, marks: Sequence[str]) -> DataFrame:
    """Counts per regular window: the grid form of interval counts, batch or streaming."""
    return events.groupBy(F.window(ts, width)).agg(*[F.count_if(F.col("mark") == m).alias(f"n_{m}") for m in marks]).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[f"n_{m}" for m in marks])
