"""Registered queries: bootstrap intervals and inference."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import bootstrap as boot
from ..operators import effects as fx
from .data import EFFECTS, METRICS, RUNS, q6, r6, runs
from .registry import query

B = 200
SEED = 7


def errors(spark, sf):
    return fx.arm_abs_error(fx.scenario_effects(runs(spark, sf), METRICS))


def draws_sql(source: str, value: str, cell: list[str], order: list[str], keys: list[str], draws: int = B, seed: int = SEED, tag: str = "") -> str:
    """CTEs units/draws: the same md5 draw rule as the Spark operator."""
    c = ", ".join(cell) or "1"
    part = f"PARTITION BY {', '.join(cell)}" if cell else ""
    using = ", ".join(cell + ["pos"])
    k = "".join(f"{x}, " for x in keys)
    return f"""units{tag} AS (SELECT {', '.join(cell) + ', ' if cell else ''}{value} AS v,
    row_number() OVER ({part} ORDER BY {', '.join(order)}) - 1 AS pos, count(*) OVER ({part}) AS n FROM {source} WHERE {value} IS NOT NULL),
  draws{tag} AS (SELECT {k}draw, avg(v) AS draw_mean FROM (
    SELECT {', '.join(cell) + ', ' if cell else ''}draw,
      ('0x' || substr(md5(concat_ws('|', {seed}, draw, pos)), 1, 8))::BIGINT % n AS pos FROM units{tag}, range({draws}) d(draw))
    JOIN units{tag} USING ({using}) GROUP BY {k}draw)"""


def interval_sql(keys: list[str], tag: str = "") -> str:
    k = "".join(f"{x}, " for x in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {k}quantile_cont(draw_mean, 0.025) AS lo, quantile_cont(draw_mean, 0.975) AS hi FROM draws{tag} {group}"


def rounded(df, cols=("mean", "lo", "hi")):
    return df.withColumns({c: r6(c) for c in cols})


KEYS = ["estimand", "regime", "alpha"]


@query("bootstrap_mean_abs_error", f"""WITH {EFFECTS}, {draws_sql('arm_errors', 'abs_error', KEYS, ['scenario'], KEYS)}
SELECT {', '.join(KEYS)}, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n
FROM (SELECT {', '.join(KEYS)}, avg(abs_error) AS mean, count(*) AS n FROM arm_errors GROUP BY ALL) JOIN ({interval_sql(KEYS)}) USING ({', '.join(KEYS)})""")
def bootstrap_mean(spark, sf):
    return rounded(boot.bootstrap_mean(errors(spark, sf), "abs_error", KEYS, ["scenario"], B, SEED))


@query("bootstrap_stratified_macro", f"""WITH {EFFECTS}, {draws_sql('arm_errors', 'abs_error', ['estimand', 'alpha', 'regime'], ['scenario'], ['estimand', 'alpha'])}
SELECT estimand, alpha, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n
FROM (SELECT estimand, alpha, avg(abs_error) AS mean, count(*) AS n FROM arm_errors GROUP BY ALL) JOIN ({interval_sql(['estimand', 'alpha'])}) USING (estimand, alpha)""")
def bootstrap_stratified(spark, sf):
    return rounded(boot.stratified_bootstrap_mean(errors(spark, sf), "abs_error", ["regime"], ["estimand", "alpha"], ["scenario"], B, SEED))


PAIR = ["estimand", "regime", "scenario"]


@query("bootstrap_paired_delta", f"""WITH {EFFECTS}, pairs AS (SELECT estimand, regime, scenario, a.abs_error - b.abs_error AS d
  FROM arm_errors a JOIN arm_errors b USING (estimand, regime, scenario) WHERE a.alpha = 0.25 AND b.alpha = 0.0),
  {draws_sql('pairs', 'd', ['estimand', 'regime'], ['scenario'], ['estimand', 'regime'])}
SELECT estimand, regime, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n,
  CASE WHEN lo > 0 THEN 'positive' WHEN hi < 0 THEN 'negative' ELSE 'unresolved' END AS label
FROM (SELECT estimand, regime, avg(d) AS mean, count(*) AS n FROM pairs GROUP BY ALL) JOIN ({interval_sql(['estimand', 'regime'])}) USING (estimand, regime)""")
def paired_delta(spark, sf):
    e = errors(spark, sf)
    got = boot.paired_delta(e.filter(F.col("alpha") == 0.25), e.filter(F.col("alpha") == 0.0), PAIR, "abs_error", ["estimand", "regime"], draws=B, seed=SEED)
    return rounded(got.withColumn("label", boot.resolved_label()))


@query("bootstrap_mae_of_bias", f"""WITH {EFFECTS}, signed AS (SELECT *, abs(effect - oracle_effect) AS a FROM arm_errors),
  {draws_sql('signed', 'a', ['estimand', 'alpha'], ['regime', 'scenario'], ['estimand', 'alpha'])}
SELECT estimand, alpha, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n
FROM (SELECT estimand, alpha, avg(a) AS mean, count(*) AS n FROM signed GROUP BY ALL) JOIN ({interval_sql(['estimand', 'alpha'])}) USING (estimand, alpha)""")
def mae_of_bias(spark, sf):
    e = errors(spark, sf).withColumn("bias", F.col("effect") - F.col("oracle_effect"))
    return rounded(boot.bootstrap_mae(e, "bias", ["estimand", "alpha"], ["regime", "scenario"], draws=B, seed=SEED))


TWO = f"""two AS (SELECT regime, policy, scenario, model, avg(goal_utility_ratio) AS v FROM runs GROUP BY ALL)"""
WELCH = """w AS (SELECT regime, avg(v) FILTER (policy='semantic') AS ma, avg(v) FILTER (policy='throughput') AS mb,
  var_samp(v) FILTER (policy='semantic') / count(*) FILTER (policy='semantic') AS sa, var_samp(v) FILTER (policy='throughput') / count(*) FILTER (policy='throughput') AS sb,
  count(*) FILTER (policy='semantic') AS na, count(*) FILTER (policy='throughput') AS nb FROM two GROUP BY regime)"""


def policy_levels(spark, sf):
    return runs(spark, sf).groupBy("regime", "policy", "scenario", "model").agg(F.avg("goal_utility_ratio").alias("v"))


@query("inference_independent_difference", f"""WITH {RUNS}, {TWO}, {WELCH},
  {draws_sql('two', 'v', ['regime', 'policy'], ['scenario', 'model'], ['regime', 'policy'])},
  diff AS (SELECT regime, draw, max(draw_mean) FILTER (policy='semantic') - max(draw_mean) FILTER (policy='throughput') AS d FROM draws GROUP BY ALL)
SELECT regime, {q6('ma - mb')} AS mean_difference, {q6('(ma - mb) / sqrt(sa + sb)')} AS t,
  {q6('pow(sa + sb, 2) / (sa * sa / (na - 1) + sb * sb / (nb - 1))', 4)} AS dof, {q6('lo')} AS lo, {q6('hi')} AS hi
FROM w JOIN (SELECT regime, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM diff GROUP BY regime) USING (regime)""")
def independent_difference(spark, sf):
    got = boot.independent_difference(policy_levels(spark, sf), "v", "policy", "semantic", "throughput", ["regime"], ["scenario", "model"], B, SEED)
    return got.select("regime", r6("mean_difference").alias("mean_difference"), r6("t").alias("t"), r6("dof", 4).alias("dof"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("bootstrap_paired_by_replicate", f"""WITH {RUNS}, {TWO}, pairs AS (SELECT a.regime, a.scenario, a.model, a.v - b.v AS d FROM two a JOIN two b USING (regime, scenario, model)
   WHERE a.policy = 'semantic' AND b.policy = 'throughput'),
  {draws_sql('pairs', 'd', ['regime'], ['scenario', 'model'], ['regime'])}
SELECT regime, {q6('mean')} AS mean, {q6('l[1 + floor(0.025 * 199)::INT]')} AS lo, {q6('l[1 + floor(0.975 * 199)::INT]')} AS hi, n
FROM (SELECT regime, avg(d) AS mean, count(*) AS n FROM pairs GROUP BY ALL)
JOIN (SELECT regime, list_sort(list(draw_mean)) AS l FROM draws GROUP BY regime) USING (regime)""")
def paired_by_replicate(spark, sf):
    two = policy_levels(spark, sf)
    pairs = boot.paired_join(two.filter("policy = 'semantic'"), two.filter("policy = 'throughput'"), ["regime", "scenario", "model"], "v")
    pairs = pairs.withColumn("d", F.col("v_a") - F.col("v_b"))
    return rounded(boot.bootstrap_mean(pairs, "d", ["regime"], ["scenario", "model"], B, SEED, exact_rank=True))


# the classical expansion of the Student-t quantile; its error is below 1e-8 from 99 degrees of freedom on
def t_half_sql(n: str, sd: str) -> str:
    z = "1.959963984540054"
    return (f"(({z} + ({z}**3 + {z}) / (4 * ({n} - 1)) + (5 * {z}**5 + 16 * {z}**3 + 3 * {z}) / (96 * ({n} - 1)**2)"
            f" + (3 * {z}**7 + 19 * {z}**5 + 17 * {z}**3 - 15 * {z}) / (384 * ({n} - 1)**3)) * {sd} / sqrt({n}))")


@query("inference_t_interval", f"""WITH {RUNS}, {TWO}
SELECT regime, policy, n, {q6('mean')} AS mean, {q6('sd')} AS sd, {q6('mean - ' + t_half_sql('n', 'sd'), 5)} AS ci95_low, {q6('mean + ' + t_half_sql('n', 'sd'), 5)} AS ci95_high
FROM (SELECT regime, policy, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM two GROUP BY ALL)""")
def t_interval(spark, sf):
    got = boot.t_interval(policy_levels(spark, sf), "v", ["regime", "policy"])
    return got.select("regime", "policy", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("ci95_low", 5).alias("ci95_low"), r6("ci95_high", 5).alias("ci95_high"))


@query("inference_condition_summary", f"""WITH {RUNS}
SELECT regime, policy, metric, n, {q6('mean')} AS mean, {q6('sd')} AS sd, {q6('mean - ' + t_half_sql('n', 'sd'), 5)} AS ci95_low, {q6('mean + ' + t_half_sql('n', 'sd'), 5)} AS ci95_high
FROM (SELECT regime, policy, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM runs
  UNPIVOT (value FOR metric IN (goal_utility_ratio, critical_success_rate, mean_latency)) GROUP BY ALL)""")
def condition_summary(spark, sf):
    got = fx.condition_summary(runs(spark, sf), METRICS, ["regime", "policy"])
    return got.select("regime", "policy", "metric", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("ci95_low", 5).alias("ci95_low"), r6("ci95_high", 5).alias("ci95_high"))


@query("inference_wilcoxon_paired_abs_error", f"""WITH {EFFECTS}, d AS (SELECT estimand, a.abs_error - b.abs_error AS d
  FROM arm_errors a JOIN arm_errors b USING (estimand, regime, scenario) WHERE a.alpha = 1.0 AND b.alpha = 0.0),
 r AS (SELECT estimand, d, rank() OVER (PARTITION BY estimand ORDER BY abs(d)) + (count(*) OVER (PARTITION BY estimand, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0),
 s AS (SELECT estimand, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm, count(*) AS n FROM r GROUP BY estimand)
SELECT estimand, least(wp, wm)::DOUBLE AS statistic, n FROM s""")
def wilcoxon(spark, sf):
    e = errors(spark, sf)
    pairs = boot.paired_join(e.filter("alpha = 1.0"), e.filter("alpha = 0.0"), PAIR, "abs_error").withColumn("d", F.col("abs_error_a") - F.col("abs_error_b"))
    return boot.wilcoxon_signed_rank(pairs, "d", ["estimand"]).select("estimand", "statistic", "n")


@query("inference_better_fraction", f"""WITH {EFFECTS}
SELECT estimand, regime, {q6('avg((a.abs_error - b.abs_error < 0)::INT)')} AS better_fraction, count(*) AS n
FROM arm_errors a JOIN arm_errors b USING (estimand, regime, scenario) WHERE a.alpha = 0.5 AND b.alpha = 0.0 GROUP BY ALL""")
def better_fraction(spark, sf):
    e = errors(spark, sf)
    pairs = boot.paired_join(e.filter("alpha = 0.5"), e.filter("alpha = 0.0"), PAIR, "abs_error").withColumn("d", F.col("abs_error_a") - F.col("abs_error_b"))
    return boot.better_fraction(pairs, "d", ["estimand", "regime"]).withColumn("better_fraction", r6("better_fraction"))


@query("seed_for_arm", f"""WITH {RUNS}
SELECT regime, scenario, replicate, model, policy, 20260812 + ('0x' || substr(sha256(concat_ws('|', regime, scenario, replicate)), 1, 8))::BIGINT AS seed FROM runs""")
def seed_for_arm(spark, sf):
    return runs(spark, sf).select("regime", "scenario", "replicate", "model", "policy",
                                  boot.seed_for(F.col("regime"), F.col("scenario"), F.col("replicate"), base=20260812).alias("seed"))


_AB = ["estimand", "regime", "model"]


@query("bootstrap_ablation_table", f"""WITH {EFFECTS},
 lv AS (SELECT estimand, regime, scenario, policy, model, avg(value) AS level FROM long GROUP BY ALL),
 le AS (SELECT a.estimand, a.regime, a.scenario, a.model, avg(abs(a.level - o.level)) AS level_error FROM lv a JOIN lv o USING (estimand, regime, scenario, policy)
   WHERE a.model <> 'oracle' AND o.model = 'oracle' GROUP BY ALL),
 d AS (SELECT estimand, regime, scenario, e.model, c.abs_error - e.abs_error AS de, cl.level_error - l.level_error AS dl
   FROM arm_errors e JOIN arm_errors c USING (estimand, regime, scenario) JOIN le l ON (l.estimand, l.regime, l.scenario, l.model) = (e.estimand, e.regime, e.scenario, e.model)
   JOIN le cl ON (cl.estimand, cl.regime, cl.scenario, cl.model) = (e.estimand, e.regime, e.scenario, c.model)
   WHERE c.model = 'residual_predictive' AND e.model <> 'residual_predictive'),
 {draws_sql('d', 'de', _AB, ['scenario'], _AB, tag='_e')}, {draws_sql('d', 'dl', _AB, ['scenario'], _AB, seed=SEED + 1, tag='_l')}
SELECT estimand, regime, model, {q6('me')} AS effect_difference, {q6('e.lo')} AS effect_difference_lo, {q6('e.hi')} AS effect_difference_hi,
  {q6('ml')} AS level_difference, {q6('l.lo')} AS level_difference_lo, {q6('l.hi')} AS level_difference_hi
FROM (SELECT estimand, regime, model, avg(de) AS me, avg(dl) AS ml FROM d GROUP BY ALL) JOIN ({interval_sql(_AB, '_e')}) e USING (estimand, regime, model)
JOIN ({interval_sql(_AB, '_l')}) l USING (estimand, regime, model)""")
def ablation(spark, sf):
    got = fx.ablation_table(runs(spark, sf), METRICS, "residual_predictive", ["mechanistic_calibrated", "residual_quarter", "residual_idcal"], B, SEED)
    cols = [f"{p}_difference{s}" for p in ("effect", "level") for s in ("", "_lo", "_hi")]
    return rounded(got.select("estimand", "regime", "model", *cols), cols)


def poisson_sql(source: str, value: str, cell: list[str], order: list[str], draws: int = B, seed: int = SEED) -> str:
    """CTE draws with hashed Poisson(1) weights: how many cumulative probabilities the hashed unit reaches."""
    cum, p, bounds = 0.0, math.exp(-1), []
    for k in range(1, 12):
        cum += p
        bounds.append(cum)
        p /= k
    ident = ", ".join(f"{c}::VARCHAR" for c in [*cell, *order])
    weight = " + ".join(f"(u >= {b!r}::DOUBLE)::INT" for b in bounds)
    keys = ", ".join(cell)
    return f"""draws AS (SELECT {keys}, draw, sum(w * v) / sum(w) AS draw_mean FROM (SELECT {keys}, draw, v, {weight} AS w FROM (
    SELECT {keys}, draw, {value} AS v, ('0x' || substr(md5(concat_ws('|', {seed}, draw, {ident})), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM {source}, range({draws}) d(draw) WHERE {value} IS NOT NULL)) GROUP BY {keys}, draw)"""


POOLED = ["estimand", "alpha"]


@query("bootstrap_poisson_weights", f"""WITH {EFFECTS}, {poisson_sql('arm_errors', 'abs_error', POOLED, ['regime', 'scenario'])}
SELECT estimand, alpha, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n
FROM (SELECT estimand, alpha, avg(abs_error) AS mean, count(*) AS n FROM arm_errors GROUP BY ALL) JOIN ({interval_sql(POOLED)}) USING (estimand, alpha)""")
def poisson(spark, sf):
    return rounded(boot.bootstrap_mean(errors(spark, sf), "abs_error", ["estimand", "alpha"], ["regime", "scenario"], B, SEED, method="poisson"))
