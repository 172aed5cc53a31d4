"""Policy effects against an oracle arm, and how faithful each arm is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ordered
from ..effects_names import BASELINE_ARM, ORACLE, POLICIES
from ..session import cut
from . import bootstrap as boot

UNIT = ("regime", "scenario")


def scenario_means(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("regime", "scenario", "model", "policy")) -> DataFrame:
    """Replicate means: the scenario, not the replicate, is the independent unit."""
    return runs.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def policy_contrast(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Semantic and throughput replicate means per metric in one pass."""
    base, other = POLICIES
    aggs = []
    for m in metrics:
        aggs.append(F.avg(F.when(F.col("policy") == other, F.col(m))).alias(f"{m}__{other}"))
        aggs.append(F.avg(F.when(F.col("policy") == base, F.col(m))).alias(f"{m}__{base}"))
    return runs.groupBy(*keys).agg(*aggs)


def scenario_effects(
    runs: DataFrame, estimands: Sequence[str], keys: Sequence[str] = ("regime", "scenario", "model", "trust")
) -> DataFrame:
    """Long table: keys, estimand, semantic, throughput, effect = semantic - throughput.

    One conditional aggregation serves all estimands; the wide row is then
    unfolded locally, so the runs are shuffled once whatever their number.
    """
    base, other = POLICIES
    wide = policy_contrast(runs, estimands, keys)
    rows = F.array(*[
        F.struct(F.lit(e).alias("estimand"), F.col(f"{e}__{other}").alias(other), F.col(f"{e}__{base}").alias(base))
        for e in estimands
    ])
    long = wide.select(*keys, F.inline(rows))
    return long.withColumn("effect", F.col(other) - F.col(base))


def with_oracle(effects: DataFrame, value: str = "effect", out: str = "oracle_effect", unit: Sequence[str] = ("estimand", *UNIT)) -> DataFrame:
    """Attach the oracle arm's value to every other arm of the same unit.

    A unit holds one row per arm, so this window partitions evenly and replaces
    a self-join; units without an oracle row are dropped, as an inner join would.
    """
    w = Window.partitionBy(*unit)
    got = effects.withColumn(out, F.max(F.when(F.col("model") == ORACLE, F.col(value))).over(w))
    return got.filter((F.col("model") != ORACLE) & F.col(out).isNotNull())


def missing_arms(effects: DataFrame, arms: Sequence[str], unit: Sequence[str] = ("estimand", *UNIT)) -> DataFrame:
    """Oracle units for which some arm is absent (coverage error rows)."""
    have = effects.filter(F.col("effect").isNotNull()).groupBy(*unit).agg(F.collect_set("model").alias("_have"))
    wanted = F.array(*[F.lit(a) for a in arms])
    gaps = have.filter(F.array_contains("_have", ORACLE)).select(*unit, F.explode(F.array_except(wanted, F.col("_have"))).alias("missing"))
    return gaps


def arm_abs_error(effects: DataFrame, alpha: float | None = None) -> DataFrame:
    """Absolute effect error of each executed arm (or of the arm of one alpha)."""
    arms = with_oracle(effects)
    if alpha is not None:
        arms = arms.filter(F.col("trust") == alpha)
    return arms.select(
        "estimand", *UNIT, "model", F.col("trust").alias("alpha"), "effect", "oracle_effect",
        F.abs(F.col("effect") - F.col("oracle_effect")).alias("abs_error"),
    )


def error_summary(err: Column, prefix: str) -> list[Column]:
    return [
        F.avg(err).alias(f"{prefix}_bias"),
        F.avg(F.abs(err)).alias(f"{prefix}_mae"),
        F.sqrt(F.avg(err * err)).alias(f"{prefix}_rmse"),
    ]


def sign_of(x: Column | str, eps: float = 0.0) -> Column:
    """Dead-zone sign; negative zero counts as zero."""
    x = F.col(x) if isinstance(x, str) else x
    if eps < 0:
        raise ValueError("a band cannot be narrower than nothing")
    return F.when(x > eps, 1).when(x < -eps, -1).when(x.isNotNull(), 0)


def effect_fidelity(effects: DataFrame, keys: Sequence[str] = ("estimand", "regime", "model")) -> DataFrame:
    """Bias, MAE, RMSE, sign agreement and rank correlation against the oracle."""
    arms = with_oracle(effects).withColumn("_e", F.col("effect") - F.col("oracle_effect"))
    # scenarios per (estimand, regime, model) are the units; ranks come from counts
    ranked = ordered.rank_average(ordered.rank_average(arms, keys, "effect", "_ra"), keys, "oracle_effect", "_ro")
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("effect").alias("effect_mean"), F.avg("oracle_effect").alias("oracle_effect_mean"),
        *error_summary(F.col("_e"), "effect"),
        F.avg((sign_of("effect") == sign_of("oracle_effect")).cast("double")).alias("sign_agreement"),
        F.corr("_ra", "_ro").alias("rank_corr"),
    )


def sign_agreement_nonzero(effects: DataFrame, keys: Sequence[str] = ("estimand", "regime", "model"), tol: float = 0.0) -> DataFrame:
    """Sign agreement over the units whose oracle effect exceeds ``tol`` in size."""
    hit = F.when(F.abs("oracle_effect") > tol, (sign_of("effect") == sign_of("oracle_effect")).cast("double"))
    return with_oracle(effects).groupBy(*keys).agg(F.avg(hit).alias("sign_agreement"), F.count(hit).alias("n_nonzero"))


def level_errors(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per (regime, scenario, policy, model, estimand): level minus oracle level."""
    means = scenario_means(runs, metrics)
    rows = F.array(*[F.struct(F.lit(m).alias("estimand"), F.col(m).alias("level")) for m in metrics])
    long = means.select("regime", "scenario", "model", "policy", F.inline(rows))
    got = with_oracle(long, "level", "oracle_level", ("estimand", "regime", "scenario", "policy"))
    return got.withColumn("level_error", F.col("level") - F.col("oracle_level"))


def level_fidelity(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("estimand", "regime", "model")) -> DataFrame:
    return level_errors(runs, metrics).groupBy(*keys).agg(*error_summary(F.col("level_error"), "level"))


def macro_average(errors: DataFrame, value: str, keys: Sequence[str], regime: str = "regime") -> DataFrame:
    """Per-regime means and the pooled macro mean (``scope = 'macro'``) in one pass."""
    got = errors.groupingSets([[*keys, regime], [*keys]], *keys, regime).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping(regime).alias("_g")
    )
    return got.select(*keys, F.when(F.col("_g") == 1, "macro").otherwise(F.col(regime)).alias("scope"), "mean", "n")


def effect_fidelity_report(runs: DataFrame, estimands: Sequence[str], draws: int = 2000, seed: int = 7) -> DataFrame:
    """Macro table: stratified intervals of effect MAE and bias plus the level MAE."""
    effects = scenario_effects(runs, estimands)
    arms = with_oracle(effects).withColumns({"bias": F.col("effect") - F.col("oracle_effect")}).withColumn("mae", F.abs("bias"))
    keys = ["estimand", "model"]
    arms = cut(arms.select(*keys, "regime", "scenario", "mae", "bias"))
    mae = boot.stratified_bootstrap_mean(arms, "mae", ["regime"], keys, ["scenario"], draws, seed)
    bias = boot.stratified_bootstrap_mean(arms, "bias", ["regime"], keys, ["scenario"], draws, seed + 1)
    level = level_errors(runs, estimands).groupBy(*keys).agg(F.avg(F.abs("level_error")).alias("level_mae"))

    def named(df, p):
        return df.select(*keys, F.col("mean").alias(f"effect_{p}"), F.col("lo").alias(f"effect_{p}_lo"), F.col("hi").alias(f"effect_{p}_hi"))

    return named(mae, "mae").join(named(bias, "bias"), keys).join(level, keys)


def paired_vs_baseline(effects: DataFrame, baseline: str = BASELINE_ARM, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Difference in absolute effect error against the baseline arm, per regime and macro."""
    errors = arm_abs_error(effects)
    w = Window.partitionBy("estimand", *UNIT)
    diff = errors.withColumn("_b", F.max(F.when(F.col("model") == baseline, F.col("abs_error"))).over(w))
    diff = diff.filter((F.col("model") != baseline) & F.col("_b").isNotNull()).withColumn("delta", F.col("abs_error") - F.col("_b"))
    diff = cut(diff.select("estimand", "model", "regime", "scenario", "delta"))
    per = boot.bootstrap_mean(diff, "delta", ["estimand", "model", "regime"], ["scenario"], draws, seed)
    pooled = boot.stratified_bootstrap_mean(diff, "delta", ["regime"], ["estimand", "model"], ["scenario"], draws, seed)
    cols = ["estimand", "model", "scope", "mean", "lo", "hi", "n"]
    return per.withColumnRenamed("regime", "scope").select(*cols).unionByName(
        pooled.withColumn("scope", F.lit("macro")).select(*cols)
    )


def ablation_table(runs: DataFrame, metrics: Sequence[str], closed: str, comparators: Sequence[str], draws: int = 2000, seed: int = 7) -> DataFrame:
    """Closed arm minus each comparator: effect-error and within-scenario level-error differences."""
    unit = ["estimand", *UNIT]
    eff = arm_abs_error(scenario_effects(runs, metrics)).select(*unit, "model", F.col("abs_error").alias("effect_error"))
    lev = level_errors(runs, metrics).groupBy(*unit, "model").agg(F.avg(F.abs("level_error")).alias("level_error"))
    both = eff.join(lev, [*unit, "model"])
    w = Window.partitionBy(*unit)
    pick = lambda c: F.max(F.when(F.col("model") == closed, F.col(c))).over(w)
    d = both.withColumns({"_ce": pick("effect_error"), "_cl": pick("level_error")}).filter(F.col("model").isin(*comparators))
    d = d.withColumns({"d_effect": F.col("_ce") - F.col("effect_error"), "d_level": F.col("_cl") - F.col("level_error")})
    keys = ["estimand", "regime", "model"]
    d = cut(d)
    e = boot.bootstrap_mean(d, "d_effect", keys, ["scenario"], draws, seed)
    l = boot.bootstrap_mean(d, "d_level", keys, ["scenario"], draws, seed + 1)
    point = d.groupBy(*keys).agg(
        F.avg("_ce").alias("closed_effect_mae"), F.avg("effect_error").alias("comparator_effect_mae"),
        F.avg("_cl").alias("closed_level_mae"), F.avg("level_error").alias("comparator_level_mae"),
    )
    name = lambda t, p: t.select(*keys, F.col("mean").alias(p), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
    return name(e, "effect_difference").join(name(l, "level_difference"), keys).join(point, keys)


def ensemble_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample sd (0 for one row), min, q05, median, q95, max."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("stdev"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    q = ordered.quantiles(df, keys, value, {"q05": 0.05, "median": 0.5, "q95": 0.95})
    return boot._attach(base, q, keys)


def nearest_rank_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd and order statistics at ``bround(p * (n - 1))``."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("stdev"),
    )
    q = ordered.quantiles(df, keys, value, {"q05": 0.05, "median": 0.5, "q95": 0.95}, method="nearest")
    return boot._attach(base, q, keys)


def ratio(num: Column, den: Column, zero: str = "nan", floor: float = 1e-12) -> Column:
    """num / den with a declared zero policy: ``nan``, ``zero``, ``null`` or ``clamp``."""
    if zero == "clamp":
        return num / F.greatest(den, F.lit(floor))
    other = {"nan": F.lit(float("nan")), "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[zero]
    return F.when(den != 0, num / den).otherwise(other)


def run_metrics(counters: DataFrame, zero: str = "nan") -> DataFrame:
    """Ratio metrics from the counters of a run.

    Expects generated, generated_critical, generated_utility, delivered, timely,
    timely_critical, timely_utility, latency_sum and energy.
    """
    c = F.col
    return counters.withColumns({
        "goal_utility_ratio": ratio(c("timely_utility"), c("generated_utility"), zero),
        "critical_success_rate": ratio(c("timely_critical"), c("generated_critical"), zero, 1.0),
        "timely_task_rate": ratio(c("timely"), c("generated"), zero, 1.0),
        "semantic_efficiency": ratio(c("timely_utility"), c("energy"), zero),
        "mean_latency": ratio(c("latency_sum"), c("delivered"), zero, 1.0),
    })


def task_counters(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rebuild the counters from task rows: kind, utility, born, delivered_at, deadline, energy."""
    done = F.col("delivered_at").isNotNull()
    timely = done & (F.col("delivered_at") - F.col("born") <= F.col("deadline"))
    critical = F.col("kind") == "critical"
    one = lambda cond: F.count_if(cond)
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("generated"), one(critical).alias("generated_critical"), F.sum("utility").alias("generated_utility"),
        one(done).alias("delivered"), one(timely).alias("timely"), one(timely & critical).alias("timely_critical"),
        F.sum(F.when(timely, F.col("utility")).otherwise(0.0)).alias("timely_utility"),
        F.sum(F.when(done, F.col("delivered_at") - F.col("born")).otherwise(0.0)).alias("latency_sum"),
        F.sum(F.when(done, F.col("energy")).otherwise(0.0)).alias("energy"),
    )


def seed_sensitivity(df: DataFrame, value: str, seed: str, keys: Sequence[str]) -> DataFrame:
    """Distinct seeds, mean, sample sd, min and max per group."""
    return df.groupBy(*keys).agg(
        F.count_distinct(seed).alias("seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def rejection_audit(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Thinning totals and the mean rejection per event, events floored at one."""
    per = F.col("thinning_rejections") / F.greatest(F.col("events"), F.lit(1))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.max("events").alias("max_events"),
        F.max("thinning_rejections").alias("max_thinning_rejections"), F.sum("thinning_rejections").alias("total_thinning_rejections"),
        F.avg(per).alias("rejection_per_event_mean"),
    )


def arm_deltas(runs: DataFrame, metric: str, oracle_policy: str, arms: Sequence[str], base: str = POLICIES[0], unit: Sequence[str] = UNIT) -> DataFrame:
    """Policy mean minus baseline mean per unit, and its distance from the oracle policy's delta."""
    names = [oracle_policy, *arms]
    wide = runs.groupBy(*unit).agg(
        F.avg(F.when(F.col("policy") == base, F.col(metric))).alias("_base"),
        *[F.avg(F.when(F.col("policy") == n, F.col(metric))).alias(f"_m_{i}") for i, n in enumerate(names)],
    )
    oracle = F.col("_m_0") - F.col("_base")
    rows = F.array(*[
        F.struct(F.lit(n).alias("arm"), (F.col(f"_m_{i + 1}") - F.col("_base")).alias("delta")) for i, n in enumerate(arms)
    ])
    got = wide.select(*unit, oracle.alias("oracle_delta"), F.inline(rows))
    return got.withColumn("mae", F.abs(F.col("delta") - F.col("oracle_delta")))


def rank_arms(errors: DataFrame, value: str = "abs_error", keys: Sequence[str] = ("estimand",)) -> DataFrame:
    """Arms of each estimand ranked by macro error (a handful of rows)."""
    macro = errors.groupBy(*keys, "model").agg(F.avg(value).alias("macro_mae"))
    w = Window.partitionBy(*keys).orderBy("macro_mae", "model")
    return macro.withColumn("rank", F.row_number().over(w).cast("long"))


def condition_summary(df: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """n, mean and Student-t interval of every metric per condition, long form."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return boot.t_interval(df.select(*keys, F.inline(rows)), "value", [*keys, "metric"])
