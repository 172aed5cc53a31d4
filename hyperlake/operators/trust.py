"""Calibrated trust: which arm (alpha) to use per estimand, intervention and regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..effects_names import (
    ARMS, DEFAULT_ALPHA, DEFAULT_LAMBDA, GRID, INTERVENTION, INVARIANCE_TOL, PRIMARY_ESTIMAND,
)
from ..session import cut
from . import bootstrap as boot
from . import effects as fx

CELL = ("estimand", "intervention", "regime")


def on_grid(errors: DataFrame, grid: Sequence[float] = GRID) -> DataFrame:
    return errors.filter(F.col("alpha").isin(*[float(a) for a in grid]))


def cell_objective(errors: DataFrame, predictive: DataFrame | None = None, lam: float = DEFAULT_LAMBDA, grid: Sequence[float] = GRID, keys: Sequence[str] = ("estimand", "regime")) -> DataFrame:
    """MAE + lambda * predictive NMAE per cell and alpha (``predictive``: alpha, nmae)."""
    mae = on_grid(errors, grid).groupBy(*keys, "alpha").agg(F.avg("abs_error").alias("mae"), F.count("abs_error").alias("n"))
    if predictive is None:
        mae = mae.withColumn("nmae", F.lit(0.0))
    else:
        # one row per alpha of the grid; an alpha without a predictive error has no objective and cannot be chosen
        mae = mae.join(predictive.select("alpha", "nmae"), "alpha", "left")
    return mae.withColumn("objective", F.col("mae") + F.lit(float(lam)) * F.col("nmae"))


def select_alpha(objectives: DataFrame, keys: Sequence[str] = ("estimand", "regime")) -> DataFrame:
    """Smallest objective, then smallest alpha."""
    best = F.min(F.when(F.col("objective").isNotNull(), F.struct("objective", "alpha")))
    # a cell none of whose alphas has an objective keeps its row, with a null alpha
    return objectives.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.alpha").alias("alpha"), F.col("_b.objective").alias("objective"))


def errors_are_invariant(errors: DataFrame, keys: Sequence[str] = ("estimand", "regime"), tol: float = INVARIANCE_TOL, grid: Sequence[float] = GRID) -> DataFrame:
    """True where every alpha gives the first alpha's error vector within ``tol``.

    Needs at least two alphas and equally long vectors; compared per scenario.
    """
    e = on_grid(errors, grid)
    first = F.min_by("abs_error", "alpha")
    per = e.groupBy(*keys, "scenario").agg(
        F.max("abs_error").alias("_hi"), F.min("abs_error").alias("_lo"), first.alias("_ref"), F.count(F.lit(1)).alias("_k")
    )
    spread = F.greatest(F.col("_hi") - F.col("_ref"), F.col("_ref") - F.col("_lo"))
    return per.groupBy(*keys).agg(
        (F.bool_and(spread <= tol) & (F.min("_k") == F.max("_k")) & (F.min("_k") >= 2)).alias("inadequacy")
    )


def fit(errors: DataFrame, predictive: DataFrame | None = None, lam: float = DEFAULT_LAMBDA, grid: Sequence[float] = GRID, intervention: str = INTERVENTION, horizon: float | None = None) -> DataFrame:
    """One calibrated cell per (estimand, regime), all cells in one grouped job."""
    keys = ["estimand", "regime"]
    obj = cell_objective(errors, predictive, lam, grid, keys)
    tag = F.format_string("%.2f", F.col("alpha"))
    # at most one entry per alpha of the grid
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(tag, F.col(c)))))
    cells = obj.groupBy(*keys).agg(
        F.min(F.struct("objective", "alpha")).getField("alpha").alias("alpha"),
        as_map("objective").alias("objective_by_alpha"), as_map("mae").alias("mae_by_alpha"),
        as_map("nmae").alias("predictive_nmae_by_alpha"), F.min_by("n", "alpha").alias("n_scenarios"),
    )
    cells = cells.join(errors_are_invariant(errors, keys, grid=grid), keys)
    return cells.select(
        "estimand", F.lit(intervention).alias("intervention"), "regime", "alpha", "objective_by_alpha", "mae_by_alpha",
        "predictive_nmae_by_alpha", "inadequacy", "n_scenarios", F.lit(horizon).cast("double").alias("calibration_horizon"),
    )


def lookup(cells: DataFrame, queries: DataFrame, share_primary: bool = False, primary: str = PRIMARY_ESTIMAND, default_alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Answer every query row: exact cell, else the primary estimand's, else the default.

    ``queries`` carries estimand, intervention and regime; every row is kept.
    Cells are one row per (estimand, regime): AQE broadcasts them while they are
    small and hash-joins them otherwise.
    """
    exact = cells.select(*CELL, F.col("alpha").alias("_exact"))
    got = queries.join(exact, list(CELL), "left")
    if share_primary:
        inherited = cells.filter(F.col("estimand") == primary).select("intervention", "regime", F.col("alpha").alias("_shared"))
        got = got.join(inherited, ["intervention", "regime"], "left")
        got = got.withColumn("_shared", F.when(F.col("estimand") != primary, F.col("_shared")))
    else:
        got = got.withColumn("_shared", F.lit(None).cast("double"))
    got = got.join(cells.select("estimand").distinct().withColumn("_e", F.lit(True)), "estimand", "left")
    got = got.join(cells.select("regime").distinct().withColumn("_r", F.lit(True)), "regime", "left")
    found, shared = F.col("_exact").isNotNull(), F.col("_shared").isNotNull()
    source = F.when(found, "calibrated_cell").when(shared, "inherit_primary_estimand").otherwise("default_mechanistic")
    notes = (
        F.when(found, "").when(shared, f"uncalibrated query inherits {primary}")
        .when(F.col("_e").isNull(), "unknown_estimand").when(F.col("_r").isNull(), "unknown_regime").otherwise("unknown_cell")
    )
    alpha = F.coalesce("_exact", "_shared", F.lit(float(default_alpha)))
    return got.withColumns({"alpha": alpha, "source": source, "notes": notes}).drop("_exact", "_shared", "_e", "_r")


def map_table(cells: DataFrame, estimands: DataFrame, regimes: DataFrame, intervention: str = INTERVENTION, **kw) -> DataFrame:
    """Lookup of every estimand x regime combination named by two key tables."""
    one = F.lit(intervention)
    grid = estimands.select("estimand", one.alias("intervention")).join(regimes.select("regime", one.alias("intervention")), "intervention")
    return lookup(cells, grid, **kw)


def arm_of(alpha: Column) -> Column:
    """Fixed arm name of an alpha, null for an alpha that no arm ran with."""
    pairs = [x for name, a in ARMS.items() if a is not None for x in (F.lit(float(a)), F.lit(name))]
    return F.create_map(*pairs)[alpha]


def field_abs_error(effects: DataFrame, cells: DataFrame, share_primary: bool = False) -> DataFrame:
    """Error of the arm the field selects, one row per oracle unit."""
    arms = fx.arm_abs_error(effects)
    units = arms.select("estimand", "regime", "scenario").distinct().withColumn("intervention", F.lit(INTERVENTION))
    chosen = lookup(cells, units, share_primary).select("estimand", "regime", "scenario", F.col("alpha").alias("_a"), "source", arm_of(F.col("alpha")).alias("model"))
    got = chosen.join(arms.drop("alpha"), ["estimand", "regime", "scenario", "model"], "left")
    return got.withColumnRenamed("_a", "alpha").select("estimand", "regime", "scenario", "alpha", "source", "model", "effect", "oracle_effect", "abs_error")


def field_violations(field: DataFrame) -> DataFrame:
    """Units where the selected arm has no row, or more than one."""
    per = field.groupBy("estimand", "regime", "scenario").agg(F.count("abs_error").alias("rows"))
    return per.filter(F.col("rows") != 1)


def summarize_errors(field: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Per regime and macro: mean error with interval, mean selected alpha."""
    keys = ["estimand", "regime"]
    field = cut(field.select("estimand", "regime", "scenario", "alpha", "abs_error"))
    per = boot.bootstrap_mean(field, "abs_error", keys, ["scenario"], draws, seed)
    alpha = field.groupBy(*keys).agg(F.avg("alpha").alias("mean_selected_alpha"))
    macro = boot.stratified_bootstrap_mean(field, "abs_error", ["regime"], ["estimand"], ["scenario"], draws, seed + 99)
    macro_alpha = field.groupBy("estimand").agg(F.avg("alpha").alias("mean_selected_alpha"))
    cols = ["estimand", "scope", "mean", "lo", "hi", "n", "mean_selected_alpha"]
    return per.join(alpha, keys).withColumnRenamed("regime", "scope").select(*cols).unionByName(
        macro.join(macro_alpha, "estimand").withColumn("scope", F.lit("macro")).select(*cols)
    )


def compare_fields(a: DataFrame, b: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Paired difference of two selectors' errors, per regime and macro."""
    on = ["estimand", "regime", "scenario"]
    a, b = cut(a.select(*on, "abs_error")), cut(b.select(*on, "abs_error"))
    per = boot.paired_delta(a, b, on, "abs_error", ["estimand", "regime"], draws=draws, seed=seed)
    macro = boot.paired_delta(a, b, on, "abs_error", ["estimand"], draws=draws, seed=seed)
    cols = ["estimand", "scope", "mean", "lo", "hi", "n"]
    return per.withColumnRenamed("regime", "scope").select(*cols).unionByName(macro.withColumn("scope", F.lit("macro")).select(*cols))


def global_alpha_table(errors: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """What each single global alpha would score (macro, stratified by regime)."""
    return boot.stratified_bootstrap_mean(errors, "abs_error", ["regime"], ["estimand", "alpha"], ["scenario"], draws, seed)


def loso(errors: DataFrame, grid: Sequence[float] = GRID, predictive: DataFrame | None = None, lam: float = 0.0) -> DataFrame:
    """Leave one scenario out: select alpha on the others, score on the held-out one.

    (sum - x) / (n - 1) needs only the cell totals, so no scenario pair is formed.
    A scenario with no other one in its cell, or no alpha with a predictive error,
    has nothing to select by: its row has a null alpha and a ``problem``.
    """
    e = on_grid(errors, grid)
    cell = ["estimand", "regime", "alpha"]
    totals = e.groupBy(*cell).agg(F.sum("abs_error").alias("_s"), F.count("abs_error").alias("_n"))
    held = e.join(totals, cell).withColumn("_loo", F.try_divide(F.col("_s") - F.col("abs_error"), F.col("_n") - 1))
    if predictive is not None:
        held = held.join(predictive.select("alpha", "nmae"), "alpha", "left").withColumn("_loo", F.col("_loo") + F.lit(lam) * F.col("nmae"))
    best = F.min(F.when(F.col("_loo").isNotNull(), F.struct("_loo", "alpha", "abs_error", "oracle_effect")))
    lone = F.max("_n") < 2
    return held.groupBy("estimand", "regime", "scenario").agg(best.alias("_b"), lone.alias("_lone")).select(
        "estimand", "regime", "scenario", F.col("_b.alpha").alias("alpha"), F.col("_b.abs_error").alias("abs_error"), F.col("_b.oracle_effect").alias("oracle_effect"),
        F.when(F.col("_b").isNull(), F.when(F.col("_lone"), "no_other_scenario").otherwise("no_predictive_error")).alias("problem"),
    )


def oracle_cell_errors(errors: DataFrame, grid: Sequence[float] = GRID) -> DataFrame:
    """Infeasible ceiling: the best executed alpha per scenario, near-ties to the smaller."""
    best = F.min(F.struct(F.round("abs_error", 15).alias("_r"), "alpha", "abs_error", "oracle_effect"))
    return on_grid(errors, grid).groupBy("estimand", "regime", "scenario").agg(best.alias("_b")).select(
        "estimand", "regime", "scenario", F.col("_b.alpha").alias("alpha"), F.col("_b.abs_error").alias("abs_error"),
        F.col("_b.oracle_effect").alias("oracle_effect"),
    )


def trust_grid(errors: DataFrame, predictive: DataFrame | None = None, weight: float = 0.0, keys: Sequence[str] = ("estimand",)) -> DataFrame:
    """Per alpha: error overall, per regime and in the worst regime, plus the objective.

    An alpha without a predictive error keeps its row; its objective is null and it is not selected.
    """
    keys = list(keys)
    per = errors.groupBy(*keys, "alpha", "regime").agg(F.sum("abs_error").alias("_s"), F.count("abs_error").alias("_n"), F.avg("abs_error").alias("_m"))
    got = per.groupBy(*keys, "alpha").agg(
        (F.sum("_s") / F.sum("_n")).alias("intervention_effect_mae"), F.max("_m").alias("worst_regime_mae"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "_m")))).alias("regime_mae"),
    )
    got = got.withColumn("predictive_nmae", F.lit(0.0)) if predictive is None else got.join(
        predictive.select("alpha", F.col("nmae").alias("predictive_nmae")), "alpha", "left"
    )
    return got.withColumn("objective", F.col("intervention_effect_mae") + F.lit(float(weight)) * F.col("predictive_nmae"))


def trust_grid_selection(grid: DataFrame, by: Sequence[str] = ("objective", "intervention_effect_mae", "predictive_nmae"), keys: Sequence[str] = ("estimand",)) -> DataFrame:
    """The alpha that minimises ``by`` in order, earlier alphas first on full ties."""
    whole = F.lit(True)
    for c in by:
        whole = whole & F.col(c).isNotNull()
    return grid.groupBy(*keys).agg(F.min(F.when(whole, F.struct(*by, "alpha"))).alias("_b")).select(
        *keys, F.col("_b.alpha").alias("alpha"), *[F.col(f"_b.{c}").alias(c) for c in by]
    )


def selection_sources(field: DataFrame) -> DataFrame:
    """How often each selector source was used, per regime."""
    return field.groupBy("estimand", "regime", "source").agg(F.count(F.lit(1)).alias("n"))


def masked_errors(rates: DataFrame, predicted: str, target: str, scale: str, mask: str, trace: str, keys: Sequence[str] = (), offset: float = 1e-5) -> DataFrame:
    """Scaled MAE and log-RMSE over masked entries: per trace first, then the mean of traces."""
    live = rates.filter(F.col(mask))
    gap = F.abs(F.col(predicted) - F.col(target)) / F.col(scale)
    logs = F.pow(F.log(F.col(predicted) + offset) - F.log(F.col(target) + offset), 2)
    per = live.groupBy(*keys, trace).agg(F.avg(gap).alias("_n"), F.sqrt(F.avg(logs)).alias("_l"))
    return per.groupBy(*keys).agg(F.avg("_n").alias("nmae"), F.avg("_l").alias("log_rmse"), F.count(F.lit(1)).alias("traces"))

