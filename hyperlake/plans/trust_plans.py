"""Registered queries: trust fields, selection and calibration grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as fx
from ..operators import trust as tr
from .bootstrap_plans import draws_sql, interval_sql
from .data import EFFECTS, METRICS, q6, r6, runs, table
from .registry import query

B, SEED = 200, 7


def effects(spark, sf):
    return fx.scenario_effects(runs(spark, sf), METRICS)


def errors(spark, sf):
    return fx.arm_abs_error(effects(spark, sf))


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def predictive(spark, sf):
    """alpha, nmae: how far each arm's tax level is from the lines' mean, relative."""
    r = runs(spark, sf).filter(F.col("trust").isNotNull())
    return r.groupBy(F.col("trust").alias("alpha")).agg((F.avg(F.abs(F.col("mean_latency") - 0.04)) / 0.04).alias("nmae"))


PRED = "pred AS (SELECT trust AS alpha, avg(abs(mean_latency - 0.04)) / 0.04 AS nmae FROM runs WHERE trust IS NOT NULL GROUP BY trust)"
OBJ = "obj AS (SELECT estimand, regime, alpha, avg(abs_error) AS mae, count(*) AS n, any_value(nmae) AS nmae, avg(abs_error) + 0.1 * any_value(nmae) AS objective FROM arm_errors JOIN pred USING (alpha) GROUP BY ALL)"
CELLS = "cells AS (SELECT estimand, regime, alpha FROM (SELECT *, row_number() OVER (PARTITION BY estimand, regime ORDER BY objective, alpha) AS rn FROM obj) WHERE rn = 1)"


@query("trust_cell_objective", f"WITH {EFFECTS}, {PRED}, {OBJ} SELECT estimand, regime, alpha, n, {q6('mae')} AS mae, {q6('nmae')} AS nmae, {q6('objective')} AS objective FROM obj")
def cell_objective(spark, sf):
    return rounded(tr.cell_objective(errors(spark, sf), predictive(spark, sf)), "mae", "nmae", "objective")


@query("trust_select_alpha", f"WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS} SELECT estimand, regime, alpha FROM cells")
def select_alpha(spark, sf):
    return tr.select_alpha(tr.cell_objective(errors(spark, sf), predictive(spark, sf))).drop("objective")


@query("trust_errors_invariant", f"""WITH {EFFECTS}, c AS (SELECT estimand, regime, scenario, max(abs_error) - min(abs_error) AS s, count(*) AS k FROM (
   SELECT * REPLACE (CASE WHEN estimand = 'mean_latency' THEN 1.0 ELSE abs_error END AS abs_error) FROM arm_errors) GROUP BY ALL)
SELECT estimand, regime, bool_and(s <= 1e-12) AND min(k) = max(k) AND min(k) >= 2 AS inadequacy FROM c GROUP BY ALL""")
def invariant(spark, sf):
    e = errors(spark, sf).withColumn("abs_error", F.when(F.col("estimand") == "mean_latency", 1.0).otherwise(F.col("abs_error")))
    return tr.errors_are_invariant(e)


@query("trust_fit_field", f"""WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS} SELECT estimand, 'semantic_vs_throughput' AS intervention, regime, c.alpha, any_value(o.n) AS n_scenarios,
 {q6("max(o.objective) FILTER (o.alpha = 0.25)")} AS objective_025, {q6("max(o.mae) FILTER (o.alpha = 1.0)")} AS mae_100, {q6("max(o.nmae) FILTER (o.alpha = 0.5)")} AS nmae_050, false AS inadequacy
 FROM cells c JOIN obj o USING (estimand, regime) GROUP BY ALL""")
def fit(spark, sf):
    cells = tr.fit(errors(spark, sf), predictive(spark, sf))
    return cells.select(
        "estimand", "intervention", "regime", "alpha", "n_scenarios", r6(F.col("objective_by_alpha")["0.25"]).alias("objective_025"),
        r6(F.col("mae_by_alpha")["1.00"]).alias("mae_100"), r6(F.col("predictive_nmae_by_alpha")["0.50"]).alias("nmae_050"), "inadequacy",
    )


def cells(spark, sf, hide=True):
    c = tr.fit(errors(spark, sf), predictive(spark, sf))
    # leave gaps so that every fallback source occurs
    return c.filter((F.col("regime") != "R") & (F.col("estimand") != "mean_latency")).filter(
        ~((F.col("estimand") == "critical_success_rate") & (F.col("regime") == "N"))) if hide else c


GAPS = "known_cells AS (SELECT * FROM cells WHERE regime <> 'R' AND estimand <> 'mean_latency' AND NOT (estimand = 'critical_success_rate' AND regime = 'N'))"
ANSWER = """answer AS (SELECT q.estimand, q.regime, coalesce(e.alpha, {shared} 0.0) AS alpha,
  CASE WHEN e.alpha IS NOT NULL THEN 'calibrated_cell' {inherit} ELSE 'default_mechanistic' END AS source,
  CASE WHEN e.alpha IS NOT NULL THEN '' {note} WHEN q.estimand NOT IN (SELECT estimand FROM known_cells) THEN 'unknown_estimand'
       WHEN q.regime NOT IN (SELECT regime FROM known_cells) THEN 'unknown_regime' ELSE 'unknown_cell' END AS notes
  FROM (SELECT DISTINCT estimand, regime FROM effects) q LEFT JOIN known_cells e USING (estimand, regime)
  LEFT JOIN (SELECT regime, alpha FROM known_cells WHERE estimand = 'goal_utility_ratio') p ON p.regime = q.regime AND q.estimand <> 'goal_utility_ratio')"""
PLAIN = ANSWER.format(shared="", inherit="", note="")
SHARED = ANSWER.format(shared="p.alpha,", inherit="WHEN p.alpha IS NOT NULL THEN 'inherit_primary_estimand'",
                       note="WHEN p.alpha IS NOT NULL THEN 'uncalibrated query inherits goal_utility_ratio'")


@query("trust_lookup_shared", f"WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS}, {GAPS}, {SHARED} SELECT estimand, regime, alpha, source, notes FROM answer")
def lookup_shared(spark, sf):
    q = effects(spark, sf).select("estimand", "regime").distinct().withColumn("intervention", F.lit(tr.INTERVENTION))
    return tr.lookup(cells(spark, sf), q, share_primary=True).select("estimand", "regime", "alpha", "source", "notes")


@query("trust_map_table", f"WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS}, {GAPS}, {PLAIN} SELECT estimand, regime, alpha, source, notes FROM answer")
def map_table(spark, sf):
    e = effects(spark, sf)
    return tr.map_table(cells(spark, sf), e.select("estimand").distinct(), e.select("regime").distinct()).select("estimand", "regime", "alpha", "source", "notes")


FIELD = "field AS (SELECT a.estimand, a.regime, e.scenario, a.alpha, a.source, e.model, e.abs_error FROM answer a JOIN arm_errors e USING (estimand, regime, alpha))"


@query("trust_field_abs_error", f"WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS}, {GAPS}, {PLAIN}, {FIELD} SELECT estimand, regime, scenario, alpha, source, model, {q6('abs_error')} AS abs_error FROM field")
def field(spark, sf):
    return rounded(tr.field_abs_error(effects(spark, sf), cells(spark, sf)).drop("effect", "oracle_effect"), "abs_error")


@query("trust_selection_sources", f"WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS}, {GAPS}, {PLAIN}, {FIELD} SELECT estimand, regime, source, count(*) AS n FROM field GROUP BY ALL")
def sources(spark, sf):
    return tr.selection_sources(tr.field_abs_error(effects(spark, sf), cells(spark, sf)))


@query("trust_summarize_errors", f"""WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS}, {GAPS}, {PLAIN}, {FIELD},
 {draws_sql('field', 'abs_error', ['estimand', 'regime'], ['scenario'], ['estimand', 'regime'], tag='_r')}, {draws_sql('field', 'abs_error', ['estimand', 'regime'], ['scenario'], ['estimand'], seed=SEED + 99, tag='_m')}
SELECT estimand, regime AS scope, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n, mean_selected_alpha FROM
 (SELECT estimand, regime, avg(abs_error) AS mean, count(*) AS n, {q6('avg(alpha)')} AS mean_selected_alpha FROM field GROUP BY ALL) JOIN ({interval_sql(['estimand', 'regime'], '_r')}) USING (estimand, regime)
UNION ALL SELECT estimand, 'macro', {q6('mean')}, {q6('lo')}, {q6('hi')}, n, mean_selected_alpha FROM
 (SELECT estimand, avg(abs_error) AS mean, count(*) AS n, {q6('avg(alpha)')} AS mean_selected_alpha FROM field GROUP BY ALL) JOIN ({interval_sql(['estimand'], '_m')}) USING (estimand)""")
def summarize(spark, sf):
    return rounded(tr.summarize_errors(tr.field_abs_error(effects(spark, sf), cells(spark, sf)), B, SEED), "mean", "lo", "hi", "mean_selected_alpha")


@query("trust_compare_fields", f"""WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS}, {GAPS}, {PLAIN}, {FIELD},
 pairs AS (SELECT estimand, regime, scenario, f.abs_error - b.abs_error AS d FROM field f JOIN arm_errors b USING (estimand, regime, scenario) WHERE b.alpha = 1.0),
 {draws_sql('pairs', 'd', ['estimand', 'regime'], ['scenario'], ['estimand', 'regime'], tag='_r')}, {draws_sql('pairs', 'd', ['estimand'], ['regime', 'scenario'], ['estimand'], tag='_m')}
SELECT estimand, regime AS scope, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n FROM
 (SELECT estimand, regime, avg(d) AS mean, count(*) AS n FROM pairs GROUP BY ALL) JOIN ({interval_sql(['estimand', 'regime'], '_r')}) USING (estimand, regime)
UNION ALL SELECT estimand, 'macro', {q6('mean')}, {q6('lo')}, {q6('hi')}, n FROM
 (SELECT estimand, avg(d) AS mean, count(*) AS n FROM pairs GROUP BY ALL) JOIN ({interval_sql(['estimand'], '_m')}) USING (estimand)""")
def compare(spark, sf):
    f = tr.field_abs_error(effects(spark, sf), cells(spark, sf))
    return rounded(tr.compare_fields(f, errors(spark, sf).filter("alpha = 1.0"), B, SEED), "mean", "lo", "hi")


@query("trust_global_alpha_table", f"""WITH {EFFECTS}, {draws_sql('arm_errors', 'abs_error', ['estimand', 'alpha', 'regime'], ['scenario'], ['estimand', 'alpha'])}
SELECT estimand, alpha, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n FROM
 (SELECT estimand, alpha, avg(abs_error) AS mean, count(*) AS n FROM arm_errors GROUP BY ALL) JOIN ({interval_sql(['estimand', 'alpha'])}) USING (estimand, alpha)""")
def global_alpha(spark, sf):
    return rounded(tr.global_alpha_table(errors(spark, sf), B, SEED), "mean", "lo", "hi")


@query("trust_leave_one_scenario_out", f"""WITH {EFFECTS}, h AS (SELECT *, (sum(abs_error) OVER w - abs_error) / (count(*) OVER w - 1) AS loo FROM arm_errors WINDOW w AS (PARTITION BY estimand, regime, alpha))
SELECT estimand, regime, scenario, alpha, {q6('abs_error')} AS abs_error, {q6('oracle_effect')} AS oracle_effect
FROM (SELECT *, row_number() OVER (PARTITION BY estimand, regime, scenario ORDER BY loo, alpha) AS rn FROM h) WHERE rn = 1""")
def loso(spark, sf):
    return rounded(tr.loso(errors(spark, sf)).drop("problem"), "abs_error", "oracle_effect")


@query("trust_best_alpha_per_scenario", f"""WITH {EFFECTS} SELECT estimand, regime, scenario, alpha, {q6('abs_error')} AS abs_error, {q6('oracle_effect')} AS oracle_effect
FROM (SELECT *, row_number() OVER (PARTITION BY estimand, regime, scenario ORDER BY round(abs_error, 15), alpha) AS rn FROM arm_errors) WHERE rn = 1""")
def best(spark, sf):
    return rounded(tr.oracle_cell_errors(errors(spark, sf)), "abs_error", "oracle_effect")


GRID = """per AS (SELECT estimand, alpha, regime, avg(abs_error) AS m, sum(abs_error) AS s, count(*) AS n FROM arm_errors GROUP BY ALL),
grid AS (SELECT estimand, alpha, sum(s) / sum(n) AS mae, max(m) AS worst, any_value(nmae) AS nmae, sum(s) / sum(n) + 0.2 * any_value(nmae) AS objective FROM per JOIN pred USING (alpha) GROUP BY estimand, alpha)"""


@query("trust_grid", f"WITH {EFFECTS}, {PRED}, {GRID} SELECT estimand, alpha, {q6('mae')} AS intervention_effect_mae, {q6('worst')} AS worst_regime_mae, {q6('nmae')} AS predictive_nmae, {q6('objective')} AS objective FROM grid")
def grid(spark, sf):
    got = tr.trust_grid(errors(spark, sf), predictive(spark, sf), 0.2).drop("regime_mae")
    return rounded(got, "intervention_effect_mae", "worst_regime_mae", "predictive_nmae", "objective")


@query("trust_grid_selection", f"WITH {EFFECTS}, {PRED}, {GRID} SELECT estimand, alpha, {q6('objective')} AS objective FROM (SELECT *, row_number() OVER (PARTITION BY estimand ORDER BY objective, mae, nmae, alpha) AS rn FROM grid) WHERE rn = 1")
def grid_selection(spark, sf):
    got = tr.trust_grid_selection(tr.trust_grid(errors(spark, sf), predictive(spark, sf), 0.2))
    return rounded(got.select("estimand", "alpha", "objective"), "objective")


RATES = """rates AS (SELECT l_suppkey AS trace, l_returnflag AS head, l_discount + 0.01 AS predicted, l_tax + 0.01 AS target, 0.08 AS scale, l_linestatus = 'F' AS mask FROM lineitem)"""


@query("rates_masked_errors", f"""WITH {RATES}, per AS (SELECT head, trace, avg(abs(predicted - target) / scale) AS n, sqrt(avg(pow(ln(predicted + 1e-5) - ln(target + 1e-5), 2))) AS l FROM rates WHERE mask GROUP BY ALL)
SELECT head, {q6('avg(n)')} AS nmae, {q6('avg(l)')} AS log_rmse, count(*) AS traces FROM per GROUP BY head""")
def masked(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("trace"), F.col("l_returnflag").alias("head"), (F.col("l_discount") + 0.01).alias("predicted"),
        (F.col("l_tax") + 0.01).alias("target"), F.lit(0.08).alias("scale"), (F.col("l_linestatus") == "F").alias("mask"),
    )
    return rounded(tr.masked_errors(li, "predicted", "target", "scale", "mask", "trace", ["head"]), "nmae", "log_rmse")
