"""Bootstrap intervals and small-sample inference as grouped Spark jobs.

A draw never materialises a B x n matrix: every (draw, position) pair is one row
that hashes to a unit, is joined to it on ``(group, position)`` and folds into a
partial average.  Draw indices come from md5 of ``seed|draw|position`` so every
engine can reproduce them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ordered
from ..session import cut

ALL = ordered.ALL


def hashed(*parts: Column) -> Column:
    """First 32 bits of the md5 of the joined parts, as BIGINT."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def seed_for(*parts: Column, base: int = 0) -> Column:
    """Stable seed: base + first four bytes of sha256 over the joined parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.lit(base) + F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based ``pos`` of every unit inside its group and the group size ``n``."""
    keys = list(keys)
    numbered = ordered.scan(df, keys, order, {"_rn": ordered.rnumber()})
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return numbered.join(sizes, keys).withColumn("pos", F.col("_rn") - 1).drop("_rn")


def draw_means(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], draws: int, seed: int,
    strata: Sequence[str] = (), method: str = "index",
) -> DataFrame:
    """Mean of each bootstrap draw per group: ``keys, draw, draw_mean``.

    ``strata`` resamples inside each stratum and pools the draws.  ``index``
    draws exactly n units with replacement.  ``poisson`` weights each unit with
    a hashed Poisson(1) count (at most 11, which a unit exceeds once in 1e9
    draws); it needs no join, suits unit tables of many millions of rows and
    agrees with ``index`` in distribution as n grows.  A draw in which every unit
    of a group has weight 0 is empty: its mean is null and intervals leave it out.
    """
    keys, strata = list(keys), list(strata)
    cell = keys + strata
    units = df.select(*cell, *[o for o in order if o not in cell], F.col(value).cast("double").alias("_v"))
    units = units.filter(F.col("_v").isNotNull())
    if not cell:
        units, cell = units.withColumn(ALL, F.lit(1)), [ALL]
    ladder = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    if method == "poisson":
        ident = F.concat_ws("|", *[F.col(c).cast("string") for c in [*cell, *order]])
        w = units.withColumn("draw", ladder).withColumn("_u", hashed(F.lit(seed), F.col("draw"), ident) / float(2**32))
        cum, weight, p = 0.0, F.lit(0), 0.36787944117144233
        for k in range(1, 12):
            cum += p
            weight = weight + F.when(F.col("_u") >= cum, 1).otherwise(0)
            p /= k
        return (
            w.withColumn("_w", weight).groupBy(*keys, "draw")
            .agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("draw_mean"))
        )
    placed = positions(units, cell, order)
    picks = placed.select(*cell, "n", "pos").withColumn("draw", ladder)
    picks = picks.select(*cell, "draw", (hashed(F.lit(seed), F.col("draw"), F.col("pos")) % F.col("n")).alias("pos"))
    drawn = picks.join(placed.select(*cell, "pos", "_v"), [*cell, "pos"])
    return drawn.groupBy(*keys, "draw").agg(F.avg("_v").alias("draw_mean"))


def interval(draws: DataFrame, keys: Sequence[str], column: str = "draw_mean", exact_rank: bool = False) -> DataFrame:
    """95 % percentile interval over the draws (their number is fixed, not data-sized)."""
    if exact_rank:
        got = F.array_sort(F.collect_list(column))
        pick = lambda p: F.element_at(got, (F.floor(F.lit(p) * (F.size(got) - 1)) + 1).cast("int"))
        return draws.groupBy(*keys).agg(pick(0.025).alias("lo"), pick(0.975).alias("hi"))
    return draws.groupBy(*keys).agg(
        F.percentile(column, F.lit(0.025)).alias("lo"), F.percentile(column, F.lit(0.975)).alias("hi")
    )


def units_of(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """The unit rows of a bootstrap, materialised in the shared folder."""
    return cut(df.select(*dict.fromkeys([*keys, *strata, *order, value])))


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return left.join(right, list(keys), "left")
    return left.withColumn(ALL, F.lit(1)).join(right.withColumn(ALL, F.lit(1)), ALL, "left").drop(ALL)


def bootstrap_mean(
    df: DataFrame, value: str, keys: Sequence[str] = (), order: Sequence[str] = (), draws: int = 2000,
    seed: int = 7, strata: Sequence[str] = (), method: str = "index", exact_rank: bool = False,
) -> DataFrame:
    """``keys, mean, lo, hi, n``; a group without values has NaN for all but ``n``, which is 0.

    The unit table is an aggregate many times smaller than its source and is read
    several times, so it is written once and the source is scanned once.
    """
    df = units_of(df, value, keys, order, strata)
    point = df.groupBy(*keys).agg(
        F.avg(F.col(value).cast("double")).alias("mean"), F.count(value).alias("n")
    )
    drawn = draw_means(df, value, keys, order, draws, seed, strata, method)
    both = _attach(point, interval(drawn, keys, exact_rank=exact_rank), keys)
    # a group without values has no mean and no interval, but it has a row
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("mean", "lo", "hi")})


def stratified_bootstrap_mean(
    df: DataFrame, value: str, strata: Sequence[str], keys: Sequence[str] = (), order: Sequence[str] = (),
    draws: int = 2000, seed: int = 7, method: str = "index",
) -> DataFrame:
    """Resample inside each stratum, pool the draws, report the pooled mean."""
    return bootstrap_mean(df, value, keys, order, draws, seed, strata, method)


def bootstrap_mae(df: DataFrame, value: str, keys: Sequence[str] = (), order: Sequence[str] = (), **kw) -> DataFrame:
    """Interval of the mean absolute value."""
    return bootstrap_mean(df.withColumn("_abs", F.abs(F.col(value))), "_abs", keys, order, **kw)


def paired_join(a: DataFrame, b: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Pair two tables on their keys; columns get suffixes ``_a`` and ``_b``."""
    return a.select(*on, F.col(column).alias(f"{column}_a")).join(b.select(*on, F.col(column).alias(f"{column}_b")), list(on))


def paired_delta(
    a: DataFrame, b: DataFrame, on: Sequence[str], column: str, keys: Sequence[str] = (), **kw
) -> DataFrame:
    """Bootstrap of a minus b over the paired units; negative means a is smaller."""
    pairs = paired_join(a, b, on, column).withColumn("_d", F.col(f"{column}_a") - F.col(f"{column}_b"))
    order = [c for c in on if c not in keys]
    return bootstrap_mean(pairs, "_d", keys, order, **kw)


def better_fraction(df: DataFrame, diff: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of pairs whose difference is negative."""
    return df.groupBy(*keys).agg(F.avg((F.col(diff) < 0).cast("double")).alias("better_fraction"), F.count(diff).alias("n"))


def resolved_label(lo: str = "lo", hi: str = "hi") -> Column:
    """Where the interval lies: positive, negative or unresolved."""
    return F.when(F.col(lo) > 0, "positive").when(F.col(hi) < 0, "negative").otherwise("unresolved")


# --- parametric pieces -------------------------------------------------------


def ln_gamma(x: Column) -> Column:
    """log Gamma by Stirling's series after shifting the argument above eight."""
    y = x + 8
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def student_p_two_sided(t: Column, df: Column, steps: int = 512) -> Column:
    """Two-sided Student-t p-value.

    With t = sqrt(df) tan(a) the tail is the integral of cos(a)^(df-1), which is
    smooth on a finite range, so a fixed Simpson sum is accurate to about 1e-9.
    """
    top = F.atan(F.abs(t) / F.sqrt(df))
    h = top / steps
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(steps)),
        F.lit(0.0),
        lambda acc, i: acc
        + F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.pow(F.cos(i * h), df - 1),
    )
    norm = F.exp(ln_gamma((df + 1) / 2) - ln_gamma(df / 2)) / 1.7724538509055159
    return F.greatest(F.lit(0.0), 1 - 2 * norm * total * h / 3)


def student_quantile_975(df: Column) -> Column:
    """0.975 quantile of Student-t by Newton steps on the density and the tail."""
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    # one and two degrees of freedom have closed forms, beyond them the expansion starts Newton
    t0 = F.when(df == 1, 12.706204736432095).when(df == 2, 4.302652729911275).otherwise(
        z + g1 / df + g2 / (df * df) + g3 / (df * df * df)
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(3)),
        t0,
        lambda t, _: F.when(df <= 2, t).otherwise(t + (student_p_two_sided(t, df) - 0.05) / (2 * _t_density(t, df))),
    )


def _t_density(t: Column, df: Column) -> Column:
    norm = F.exp(ln_gamma((df + 1) / 2) - ln_gamma(df / 2)) / F.sqrt(df * 3.141592653589793)
    return norm * F.pow(1 + t * t / df, -(df + 1) / 2)


def t_interval(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean with its two-sided 95 % Student-t interval."""
    got = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    half = student_quantile_975((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt(F.col("n"))
    return got.withColumn("_h", F.when(F.col("n") > 1, half)).select(
        *keys, "n", "mean", "sd", (F.col("mean") - F.col("_h")).alias("ci95_low"), (F.col("mean") + F.col("_h")).alias("ci95_high")
    )


def welch(df: DataFrame, value: str, arm: str, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Welch t statistic, degrees of freedom and p-value of arm a against arm b."""
    def of(name, fn):
        return fn(F.when(F.col(arm) == name, F.col(value)))

    got = df.filter(F.col(arm).isin(a, b)).groupBy(*keys).agg(
        of(a, F.avg).alias("ma"), of(b, F.avg).alias("mb"), of(a, F.var_samp).alias("va"), of(b, F.var_samp).alias("vb"),
        of(a, F.count).alias("na"), of(b, F.count).alias("nb"),
    )
    sa, sb = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    # an arm of one unit, or without spread, has no test: its columns are null
    dof = F.try_divide(F.pow(sa + sb, 2), F.try_divide(sa * sa, F.col("na") - 1) + F.try_divide(sb * sb, F.col("nb") - 1))
    got = got.withColumns({"mean_difference": F.col("ma") - F.col("mb"), "t": F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(sa + sb)), "dof": dof})
    return got.select(*keys, "mean_difference", "t", "dof", student_p_two_sided(F.col("t"), F.col("dof")).alias("welch_p"))


def independent_difference(
    df: DataFrame, value: str, arm: str, a: str, b: str, keys: Sequence[str], order: Sequence[str],
    draws: int = 2000, seed: int = 7,
) -> DataFrame:
    """Two-sample bootstrap of mean(a) - mean(b) with Welch's p-value."""
    df = units_of(df.filter(F.col(arm).isin(a, b)), value, [*keys, arm], order)
    both = draw_means(df, value, [*keys, arm], order, draws, seed)
    diffs = both.groupBy(*keys, "draw").agg(
        (F.max(F.when(F.col(arm) == a, F.col("draw_mean"))) - F.max(F.when(F.col(arm) == b, F.col("draw_mean")))).alias("draw_mean")
    )
    return _attach(welch(df, value, arm, a, b, keys), interval(diffs, keys), keys)


def wilcoxon_signed_rank(df: DataFrame, diff: str, keys: Sequence[str] = ()) -> DataFrame:
    """Signed-rank statistic with zeros dropped, ties averaged, normal p-value."""
    keys = list(keys)
    d = df.select(*keys, F.col(diff).alias("_d")).filter(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    # signed counts per distinct magnitude: ranks need no row-level shuffle
    tied = d.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_p"))
    cum = ordered.scan(tied, keys, ["_a"], {"_before": ordered.rsum("_n", inclusive=False)})
    rank = F.col("_before") + (F.col("_n") + 1) / 2
    got = cum.groupBy(*keys).agg(
        F.sum(rank * F.col("_p")).alias("w_plus"), F.sum(rank * (F.col("_n") - F.col("_p"))).alias("w_minus"),
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("_ties"),
    )
    n = F.col("n")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = (F.least("w_plus", "w_minus") - mean) / F.sqrt(var)
    return got.select(*keys, F.least("w_plus", "w_minus").alias("statistic"), "n", z.alias("z"), normal_p_two_sided(z).alias("wilcoxon_p"))


def normal_p_two_sided(z: Column, steps: int = 256) -> Column:
    """Two-sided normal tail by a Simpson sum of the density on [0, |z|]."""
    top = F.least(F.abs(z), F.lit(12.0))
    h = top / steps
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(steps)),
        F.lit(0.0),
        lambda acc, i: acc
        + F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.exp(-(i * h) * (i * h) / 2),
    )
    return F.greatest(F.lit(0.0), 1 - 2 * total * h / 3 * 0.3989422804014327)


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with averaged ties."""
    ranked = ordered.rank_average(ordered.rank_average(df, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rank_corr"))
