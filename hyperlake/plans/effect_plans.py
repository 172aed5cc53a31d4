"""Registered queries: effects, fidelity, summaries, design audits."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..effects_names import ARMS, POLICIES

from ..operators import effects as fx
from ..sources import runs as rs
from .bootstrap_plans import draws_sql, interval_sql
from .data import EFFECTS, METRICS, RUNS, q6, r6, runs, table
from .registry import query

B, SEED = 200, 7
UNIT = "estimand, regime, scenario"


def effects(spark, sf):
    return fx.scenario_effects(runs(spark, sf), METRICS)


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("runs_scenario_means", f"""WITH {RUNS} SELECT regime, scenario, model, policy, {', '.join(f'{q6(f"avg({m})")} AS {m}' for m in METRICS)} FROM runs GROUP BY ALL""")
def scenario_means(spark, sf):
    return rounded(fx.scenario_means(runs(spark, sf), METRICS), *METRICS)


@query("effects_by_scenario", f"WITH {EFFECTS} SELECT {UNIT}, model, {q6('semantic')} AS semantic, {q6('throughput')} AS throughput, {q6('effect')} AS effect FROM effects")
def scenario_effects(spark, sf):
    return rounded(effects(spark, sf).drop("trust"), "semantic", "throughput", "effect")


@query("effects_oracle_join", f"WITH {EFFECTS} SELECT {UNIT}, model, {q6('effect')} AS effect, {q6('oracle_effect')} AS oracle_effect FROM arm_errors")
def oracle_join(spark, sf):
    return rounded(fx.with_oracle(effects(spark, sf)).select("estimand", "regime", "scenario", "model", "effect", "oracle_effect"), "effect", "oracle_effect")


@query("effects_arm_abs_error", f"WITH {EFFECTS} SELECT {UNIT}, model, alpha, {q6('abs_error')} AS abs_error FROM arm_errors WHERE alpha = 0.5")
def arm_abs_error(spark, sf):
    return rounded(fx.arm_abs_error(effects(spark, sf), 0.5).select("estimand", "regime", "scenario", "model", "alpha", "abs_error"), "abs_error")


@query("effects_missing_arms", f"""WITH {EFFECTS}, sparse AS (SELECT * FROM effects WHERE NOT (model = 'residual_quarter' AND scenario % 3 = 0))
SELECT {UNIT}, m.model AS missing FROM (SELECT DISTINCT {UNIT} FROM sparse WHERE model = 'oracle') u, (SELECT DISTINCT model FROM effects) m
WHERE NOT EXISTS (SELECT 1 FROM sparse s WHERE (s.estimand, s.regime, s.scenario, s.model) = (u.estimand, u.regime, u.scenario, m.model))""")
def missing_arms(spark, sf):
    sparse = effects(spark, sf).filter(~((F.col("model") == "residual_quarter") & (F.col("scenario") % 3 == 0)))
    return fx.missing_arms(sparse, list(ARMS))


SIGN = "CASE WHEN {0} > 0 THEN 1 WHEN {0} < 0 THEN -1 ELSE 0 END"
RANK = "rank() OVER (PARTITION BY estimand, regime, model ORDER BY {0}) + (count(*) OVER (PARTITION BY estimand, regime, model, {0}) - 1) / 2.0"


@query("effects_fidelity", f"""WITH {EFFECTS}, r AS (SELECT *, effect - oracle_effect AS e, {RANK.format('effect')} AS ra, {RANK.format('oracle_effect')} AS ro FROM arm_errors)
SELECT estimand, regime, model, count(*) AS n, {q6('avg(effect)')} AS effect_mean, {q6('avg(oracle_effect)')} AS oracle_effect_mean,
 {q6('avg(e)')} AS effect_bias, {q6('avg(abs(e))')} AS effect_mae, {q6('sqrt(avg(e*e))')} AS effect_rmse,
 {q6(f"avg(({SIGN.format('effect')} = {SIGN.format('oracle_effect')})::INT)")} AS sign_agreement, {q6('corr(ra, ro)')} AS rank_corr FROM r GROUP BY ALL""")
def effect_fidelity(spark, sf):
    got = fx.effect_fidelity(effects(spark, sf))
    return rounded(got, "effect_mean", "oracle_effect_mean", "effect_bias", "effect_mae", "effect_rmse", "sign_agreement", "rank_corr")


@query("effects_sign_agreement_nonzero", f"""WITH {EFFECTS}
SELECT estimand, regime, model, {q6(f"avg(CASE WHEN abs(oracle_effect) > 0.001 THEN ({SIGN.format('effect')} = {SIGN.format('oracle_effect')})::INT END)")} AS sign_agreement,
 count(*) FILTER (abs(oracle_effect) > 0.001) AS n_nonzero FROM arm_errors GROUP BY ALL""")
def sign_agreement(spark, sf):
    return rounded(fx.sign_agreement_nonzero(effects(spark, sf), tol=0.001), "sign_agreement")


LEVELS = """lv AS (SELECT estimand, regime, scenario, policy, model, avg(value) AS level FROM long GROUP BY ALL),
le AS (SELECT a.*, a.level - o.level AS e FROM lv a JOIN lv o USING (estimand, regime, scenario, policy) WHERE a.model <> 'oracle' AND o.model = 'oracle')"""


@query("effects_level_fidelity", f"""WITH {EFFECTS}, {LEVELS} SELECT estimand, regime, model, {q6('avg(e)')} AS level_bias, {q6('avg(abs(e))')} AS level_mae, {q6('sqrt(avg(e*e))')} AS level_rmse FROM le GROUP BY ALL""")
def level_fidelity(spark, sf):
    return rounded(fx.level_fidelity(runs(spark, sf), METRICS), "level_bias", "level_mae", "level_rmse")


@query("effects_macro_average", f"""WITH {EFFECTS} SELECT estimand, model, coalesce(regime, 'macro') AS scope, {q6('avg(abs_error)')} AS mean, count(*) AS n
FROM arm_errors GROUP BY GROUPING SETS ((estimand, model, regime), (estimand, model))""")
def macro_average(spark, sf):
    return rounded(fx.macro_average(fx.arm_abs_error(effects(spark, sf)), "abs_error", ["estimand", "model"]), "mean")


K = ["estimand", "model"]


@query("effects_fidelity_report", f"""WITH {EFFECTS}, {LEVELS}, b AS (SELECT *, effect - oracle_effect AS bias FROM arm_errors),
 {draws_sql('b', 'abs_error', [*K, 'regime'], ['scenario'], K, tag='_m')}, {draws_sql('b', 'bias', [*K, 'regime'], ['scenario'], K, seed=SEED + 1, tag='_b')}
SELECT estimand, model, {q6('mae')} AS effect_mae, {q6('m.lo')} AS effect_mae_lo, {q6('m.hi')} AS effect_mae_hi,
 {q6('bias')} AS effect_bias, {q6('x.lo')} AS effect_bias_lo, {q6('x.hi')} AS effect_bias_hi, {q6('level_mae')} AS level_mae
FROM (SELECT estimand, model, avg(abs_error) AS mae, avg(bias) AS bias FROM b GROUP BY ALL)
JOIN ({interval_sql(K, '_m')}) m USING (estimand, model) JOIN ({interval_sql(K, '_b')}) x USING (estimand, model)
JOIN (SELECT estimand, model, avg(abs(e)) AS level_mae FROM le GROUP BY ALL) USING (estimand, model)""")
def fidelity_report(spark, sf):
    got = fx.effect_fidelity_report(runs(spark, sf), METRICS, B, SEED)
    return rounded(got, *[c for c in got.columns if c not in K])


P = ["estimand", "model", "regime"]


@query("effects_paired_vs_baseline", f"""WITH {EFFECTS}, d AS (SELECT estimand, regime, scenario, e.model, e.abs_error - b.abs_error AS delta
   FROM arm_errors e JOIN arm_errors b USING (estimand, regime, scenario) WHERE b.model = 'mechanistic_calibrated' AND e.model <> b.model),
 {draws_sql('d', 'delta', P, ['scenario'], P, tag='_r')}, {draws_sql('d', 'delta', P, ['scenario'], K, tag='_p')}
SELECT estimand, model, regime AS scope, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n
FROM (SELECT estimand, model, regime, avg(delta) AS mean, count(*) AS n FROM d GROUP BY ALL) JOIN ({interval_sql(P, '_r')}) USING (estimand, model, regime)
UNION ALL SELECT estimand, model, 'macro', {q6('mean')}, {q6('lo')}, {q6('hi')}, n
FROM (SELECT estimand, model, avg(delta) AS mean, count(*) AS n FROM d GROUP BY ALL) JOIN ({interval_sql(K, '_p')}) USING (estimand, model)""")
def paired_vs_baseline(spark, sf):
    return rounded(fx.paired_vs_baseline(effects(spark, sf), draws=B, seed=SEED), "mean", "lo", "hi")


@query("effects_rank_arms", f"""WITH {EFFECTS} SELECT estimand, model, {q6('m')} AS macro_mae, row_number() OVER (PARTITION BY estimand ORDER BY m, model) AS rank
FROM (SELECT estimand, model, avg(abs_error) AS m FROM arm_errors GROUP BY ALL)""")
def rank_arms(spark, sf):
    return rounded(fx.rank_arms(fx.arm_abs_error(effects(spark, sf))), "macro_mae")


# summaries over the raw order lines: groups that grow with the data
@query("summary_ensemble_linear_quantiles", f"""SELECT l_returnflag, count(*) AS count, {q6('avg(l_extendedprice)', 3)} AS mean, {q6('stddev_samp(l_extendedprice)', 3)} AS stdev,
 min(l_extendedprice) AS min, max(l_extendedprice) AS max, {q6('quantile_cont(l_extendedprice, 0.05)', 4)} AS q05, {q6('quantile_cont(l_extendedprice, 0.5)', 4)} AS median,
 {q6('quantile_cont(l_extendedprice, 0.95)', 4)} AS q95 FROM lineitem GROUP BY ALL""")
def ensemble_summary(spark, sf):
    got = fx.ensemble_summary(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"])
    return got.withColumns({"mean": r6("mean", 3), "stdev": r6("stdev", 3), **{c: r6(c, 4) for c in ("q05", "median", "q95")}})


@query("summary_nearest_rank_quantiles", f"""WITH a AS (SELECT l_linestatus, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, list_sort(list(l_extendedprice)) AS l FROM lineitem GROUP BY ALL)
SELECT l_linestatus, n, {q6('mean', 3)} AS mean, {q6('sd', 3)} AS stdev, l[round_even(0.05 * (n - 1), 0)::BIGINT + 1] AS q05, l[round_even(0.5 * (n - 1), 0)::BIGINT + 1] AS median,
 l[round_even(0.95 * (n - 1), 0)::BIGINT + 1] AS q95 FROM a""")
def nearest_rank(spark, sf):
    got = fx.nearest_rank_summary(table(spark, sf, "lineitem").select("l_linestatus", "l_extendedprice"), "l_extendedprice", ["l_linestatus"])
    return got.withColumns({"mean": r6("mean", 3), "stdev": r6("stdev", 3)})


TASKS = """tasks AS (SELECT l_suppkey % 20 AS run, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical' ELSE 'background' END AS kind,
  l_extendedprice / 1000 AS utility, epoch(o_orderdate) / 86400 AS born,
  CASE WHEN l_linestatus = 'F' THEN epoch(l_shipdate) / 86400 END AS delivered_at, 60.0 AS deadline, l_quantity AS energy
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
counters AS (SELECT run, count(*) AS generated, count(*) FILTER (kind = 'critical') AS generated_critical, sum(utility) AS generated_utility,
  count(delivered_at) AS delivered, count(*) FILTER (delivered_at - born <= deadline) AS timely,
  count(*) FILTER (delivered_at - born <= deadline AND kind = 'critical') AS timely_critical,
  coalesce(sum(utility) FILTER (delivered_at - born <= deadline), 0) AS timely_utility,
  coalesce(sum(delivered_at - born) FILTER (delivered_at IS NOT NULL), 0) AS latency_sum, coalesce(sum(energy) FILTER (delivered_at IS NOT NULL), 0) AS energy
  FROM tasks GROUP BY run)"""


def tasks(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_shipdate", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 / 86400
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_suppkey") % 20).alias("run"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "critical").otherwise("background").alias("kind"),
        (F.col("l_extendedprice") / 1000).alias("utility"), day("o_orderdate").alias("born"),
        F.when(F.col("l_linestatus") == "F", day("l_shipdate")).alias("delivered_at"), F.lit(60.0).alias("deadline"), F.col("l_quantity").alias("energy"),
    )


@query("runs_task_counters", f"""WITH {TASKS} SELECT run, generated, generated_critical, {q6('generated_utility', 3)} AS generated_utility, delivered, timely, timely_critical,
 {q6('timely_utility', 3)} AS timely_utility, {q6('latency_sum', 3)} AS latency_sum, {q6('energy', 3)} AS energy FROM counters""")
def task_counters(spark, sf):
    got = fx.task_counters(tasks(spark, sf), ["run"])
    return got.withColumns({c: r6(c, 3) for c in ("generated_utility", "timely_utility", "latency_sum", "energy")})


@query("runs_ratio_metrics", f"""WITH {TASKS} SELECT run, {q6('timely_utility / greatest(generated_utility, 1e-12)')} AS goal_utility_ratio,
 {q6('timely_critical / greatest(generated_critical, 1)')} AS critical_success_rate, {q6('timely / greatest(generated, 1)')} AS timely_task_rate,
 {q6('timely_utility / greatest(energy, 1e-12)')} AS semantic_efficiency, {q6('latency_sum / greatest(delivered, 1)', 5)} AS mean_latency FROM counters""")
def ratio_metrics(spark, sf):
    got = fx.run_metrics(fx.task_counters(tasks(spark, sf), ["run"]), zero="clamp")
    names = ("goal_utility_ratio", "critical_success_rate", "timely_task_rate", "semantic_efficiency")
    return got.select("run", *[r6(c).alias(c) for c in names], r6("mean_latency", 5).alias("mean_latency"))


@query("runs_seed_sensitivity", f"""WITH {RUNS} SELECT model, regime, count(DISTINCT scenario) AS seeds, {q6('avg(mean_latency)')} AS mean, {q6('stddev_samp(mean_latency)')} AS sd,
 {q6('min(mean_latency)')} AS min, {q6('max(mean_latency)')} AS max FROM runs GROUP BY ALL""")
def seed_sensitivity(spark, sf):
    return rounded(fx.seed_sensitivity(runs(spark, sf), "mean_latency", "scenario", ["model", "regime"]), "mean", "sd", "min", "max")


@query("runs_rejection_audit", f"""WITH {RUNS} SELECT model, count(*) AS rows, max(events) AS max_events, max(thinning_rejections) AS max_thinning_rejections,
 sum(thinning_rejections)::BIGINT AS total_thinning_rejections, {q6('avg(thinning_rejections / greatest(events, 1))')} AS rejection_per_event_mean FROM runs GROUP BY ALL""")
def rejection_audit(spark, sf):
    return rounded(fx.rejection_audit(runs(spark, sf), ["model"]), "rejection_per_event_mean")


DELTA = """pol AS (SELECT regime, scenario, CASE WHEN policy = 'throughput' THEN policy ELSE model END AS policy, goal_utility_ratio AS m FROM runs)"""


@query("effects_arm_deltas_vs_oracle_policy", f"""WITH {RUNS}, {DELTA}, w AS (SELECT regime, scenario, avg(m) FILTER (policy = 'throughput') AS base, avg(m) FILTER (policy = 'oracle') AS o,
  avg(m) FILTER (policy = 'residual_quarter') AS a, avg(m) FILTER (policy = 'residual_idcal') AS b FROM pol GROUP BY ALL)
SELECT regime, scenario, {q6('o - base')} AS oracle_delta, 'residual_quarter' AS arm, {q6('a - base')} AS delta, {q6('abs(a - o)')} AS mae FROM w
UNION ALL SELECT regime, scenario, {q6('o - base')}, 'residual_idcal', {q6('b - base')}, {q6('abs(b - o)')} FROM w""")
def arm_deltas(spark, sf):
    r = runs(spark, sf).withColumn("policy", F.when(F.col("policy") == "throughput", F.col("policy")).otherwise(F.col("model")))
    return rounded(fx.arm_deltas(r, "goal_utility_ratio", "oracle", ["residual_quarter", "residual_idcal"]), "oracle_delta", "delta", "mae")


# --- run-table sources and audits -------------------------------------------

ARM_KEY = "regime, scenario, replicate, model, policy"


@query("runs_missing_arms_resume", f"""WITH {RUNS}, done AS (SELECT * FROM runs WHERE NOT (model = 'residual_idcal' AND replicate = 1 AND scenario % 4 = 0))
SELECT r.regime, s.scenario, p.replicate, m.model, q.policy FROM (SELECT DISTINCT regime FROM runs) r, (SELECT DISTINCT scenario FROM runs) s, (SELECT DISTINCT replicate FROM runs) p,
 (SELECT DISTINCT model FROM runs) m, (SELECT DISTINCT policy FROM runs) q
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE (d.regime, d.scenario, d.replicate, d.model, d.policy) = (r.regime, s.scenario, p.replicate, m.model, q.policy))""")
def missing_runs(spark, sf):
    r = runs(spark, sf)
    done = r.filter(~((F.col("model") == "residual_idcal") & (F.col("replicate") == 1) & (F.col("scenario") % 4 == 0)))
    units = r.select("regime").distinct()
    levels = {"scenario": r.select("scenario"), "replicate": r.select("replicate")}
    return rs.missing_arms(rs.planned(units, levels, {"model": list(ARMS), "policy": list(POLICIES)}), done)


@query("runs_dedup_keep_last_shard", f"""WITH {RUNS}, shards AS (SELECT *, 0 AS shard FROM runs UNION ALL SELECT * REPLACE (goal_utility_ratio + 1 AS goal_utility_ratio), 1 AS shard FROM runs WHERE model = 'oracle')
SELECT {ARM_KEY}, shard, {q6('goal_utility_ratio')} AS goal_utility_ratio FROM (SELECT *, row_number() OVER (PARTITION BY {ARM_KEY} ORDER BY shard DESC) AS rn FROM shards) WHERE rn = 1""")
def dedup(spark, sf):
    r = runs(spark, sf)
    later = r.filter(F.col("model") == "oracle").withColumn("goal_utility_ratio", F.col("goal_utility_ratio") + 1)
    both = rs.union_shards([r.withColumn("shard", F.lit(0)), later.withColumn("shard", F.lit(1))])
    got = rs.dedup_keep_last(both, rs.ARM_KEY, "shard")
    return rounded(got.select(*rs.ARM_KEY, "shard", "goal_utility_ratio"), "goal_utility_ratio")


@query("runs_seed_audit", f"""WITH {RUNS}, s AS (SELECT *, CASE WHEN scenario % 7 = 0 AND model = 'oracle' THEN 'x' ELSE concat_ws('|', regime, scenario, replicate) END AS seed FROM runs)
SELECT regime, scenario, replicate, count(DISTINCT seed) AS seeds FROM s GROUP BY ALL HAVING count(DISTINCT seed) <> 1""")
def seed_audit(spark, sf):
    seed = F.when((F.col("scenario") % 7 == 0) & (F.col("model") == "oracle"), "x").otherwise(F.concat_ws("|", "regime", F.col("scenario").cast("string"), F.col("replicate").cast("string")))
    return rs.seed_audit(runs(spark, sf).withColumn("seed", seed))


@query("runs_factorial_audit", f"""WITH {RUNS} SELECT count(*) AS rows, count(*) - count(DISTINCT ({ARM_KEY})) AS duplicate_arm_keys,
 count(DISTINCT regime) AS regimes, count(DISTINCT model) AS models, count(DISTINCT policy) AS policies,
 count(DISTINCT ({ARM_KEY}, events)) AS unique_state_hashes, sum(events)::BIGINT AS accepted_events, sum(thinning_rejections)::BIGINT AS thinning_rejections FROM runs""")
def factorial_audit(spark, sf):
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in (*rs.ARM_KEY, "events")]), 256)
    return rs.design_audit(runs(spark, sf).withColumn("final_hash", key))


@query("lineitem_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return rs.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


