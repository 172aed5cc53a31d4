"""May an effect be claimed?  Statuses, foils, licences and decision packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..effects_names import ARMS, GRID, INTERVENTION, NOTES, ORACLE, STATUSES
from ..session import cut
from . import bootstrap as boot
from . import effects as fx

COUNTS = ("events", "outages", "handovers", "reroutes")
UNIT = ("estimand", "regime", "scenario")


def signed(x: Column, eps: Column | float) -> Column:
    """Dead-zone sign: 1 above eps, -1 below -eps, else 0; null stays null."""
    eps = eps if isinstance(eps, Column) else F.lit(float(eps))
    return F.when(x > eps, 1).when(x < -eps, -1).when(x.isNotNull(), 0)


def incomplete_ensembles(rows: DataFrame, hypotheses: Sequence[float] = GRID, keys: Sequence[str] = UNIT) -> DataFrame:
    """Units whose alphas are not exactly the declared ones (missing / extra lists)."""
    want = F.array(*[F.lit(float(a)) for a in hypotheses])
    have = rows.groupBy(*keys).agg(F.collect_set("alpha").alias("_have"))
    got = have.select(*keys, F.array_except(want, F.col("_have")).alias("missing"), F.array_except(F.col("_have"), want).alias("extra"))
    return got.filter((F.size("missing") > 0) | (F.size("extra") > 0))


def status_of(oracle_sign: Column, signs: Column) -> Column:
    kinds = F.array_distinct(signs)
    only = F.element_at(kinds, 1)
    alone = F.size(kinds) == 1
    return (
        F.when(oracle_sign == 0, "outcome_unknown").when(alone & (only == 0), "reject")
        .when(alone & (only == oracle_sign), "admit").when(alone, "reject").otherwise("hold_unresolved")
    )


def notes_of(oracle_sign: Column, signs: Column) -> Column:
    kinds = F.array_distinct(signs)
    only = F.element_at(kinds, 1)
    alone = F.size(kinds) == 1
    return (
        F.when(oracle_sign == 0, NOTES["outcome_unknown"]).when(alone & (only == 0), NOTES["silent"])
        .when(alone & (only == oracle_sign), NOTES["admit"]).when(alone, NOTES["against"]).otherwise(NOTES["hold_unresolved"])
    )


def score(ensembles: DataFrame, eps: Sequence[float] = (0.0,), horizon: float = 0.0, intervention: str = INTERVENTION) -> DataFrame:
    """Score every claim for every eps.

    ``ensembles``: unit keys, oracle_effect, effects_by_alpha MAP<STRING,DOUBLE>
    and response_activation.
    """
    rows = ensembles.withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in eps])))
    e = F.col("eps")
    rows = rows.withColumns({
        "oracle_sign": signed(F.col("oracle_effect"), e),
        "signs_by_alpha": F.transform_values("effects_by_alpha", lambda _, v: signed(v, e)),
    })
    signs, values, o = F.map_values("signs_by_alpha"), F.map_values("effects_by_alpha"), F.col("oracle_sign")
    return rows.withColumns({
        "intervention": F.lit(intervention),
        "horizon": F.lit(float(horizon)),
        "effect_expressed": o != 0,
        "activation_without_effect": F.col("response_activation") & (o == 0),
        "status": status_of(o, signs),
        "notes": notes_of(o, signs),
        "spread": F.array_max(values) - F.array_min(values),
    })


def activation_contrast(runs: DataFrame, counts: Sequence[str] = COUNTS) -> DataFrame:
    """Oracle-arm policy contrast of each count and whether any of them moved."""
    wide = fx.policy_contrast(runs.filter(F.col("model") == ORACLE), counts, ["regime", "scenario"])
    gaps = {c: F.col(f"{c}__semantic") - F.col(f"{c}__throughput") for c in counts}
    moved = None
    for c in counts:
        hit = F.abs(F.col(c)) > 0
        moved = hit if moved is None else moved | hit
    return wide.select("regime", "scenario", *[g.alias(c) for c, g in gaps.items()]).withColumn("response_activation", F.coalesce(moved, F.lit(False)))


def ensembles(runs: DataFrame, estimands: Sequence[str], hypotheses: Sequence[float] = GRID, arms: DataFrame | None = None) -> DataFrame:
    """One row per oracle unit with its arms folded into ``effects_by_alpha``; ``arms`` are their errors where a caller has them."""
    arms = (fx.arm_abs_error(fx.scenario_effects(runs, estimands)) if arms is None else arms).filter(F.col("alpha").isin(*[float(a) for a in hypotheses]))
    entry = F.struct(F.format_string("%.2f", F.col("alpha")), F.col("effect"))
    folded = arms.groupBy(*UNIT).agg(
        F.max("oracle_effect").alias("oracle_effect"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("effects_by_alpha")
    )
    return folded.join(activation_contrast(runs).select("regime", "scenario", "response_activation"), ["regime", "scenario"])


def score_table(runs: DataFrame, estimands: Sequence[str], eps: Sequence[float] = (0.0,), horizon: float = 0.0, hypotheses: Sequence[float] = GRID) -> DataFrame:
    """Claims of all units; a unit without exactly the declared alphas and effects has a ``problem`` and no status."""
    # asked for gaps and folded: the runs are read once for both
    arms = cut(fx.arm_abs_error(fx.scenario_effects(runs, estimands)))
    gaps = incomplete_ensembles(arms.filter(F.col("effect").isNotNull()), hypotheses).select(*UNIT, F.lit("incomplete_ensemble").alias("problem"))
    found = score(ensembles(runs, estimands, hypotheses, arms), eps, horizon).join(gaps, list(UNIT), "left")
    sound = F.col("problem").isNull()
    return found.withColumns({c: F.when(sound, F.col(c)) for c in ("status", "notes", "spread")})


def point_direction(oracle_effect: Column, point: Column, eps: Column | float) -> Column:
    o, p = signed(oracle_effect, eps), signed(point, eps)
    return F.when(o.isNull() | p.isNull() | (o == 0) | (p == 0), "unknown").when(o == p, "match").otherwise("mismatch")


def illegal_promotion(status: Column, direction: Column) -> Column:
    return (direction == "match") & status.isin("hold_unresolved", "reject")


def annotate_foil(claims: DataFrame, name: str, alpha: Column) -> DataFrame:
    """Add ``<name>_alpha``, ``_direction`` and ``_illegal_promotion`` for one point selector."""
    a = alpha.cast("double")
    point = F.col("effects_by_alpha")[F.format_string("%.2f", a)]
    direction = point_direction(F.col("oracle_effect"), point, F.col("eps"))
    return claims.withColumns({
        f"{name}_alpha": a, f"{name}_direction": direction, f"{name}_illegal_promotion": illegal_promotion(F.col("status"), direction),
    })


def annotate_foils(claims: DataFrame, table: DataFrame, table_name: str = "table", fixed: float = 1.0) -> DataFrame:
    """Two foils: a lookup table (estimand, regime, foil_alpha) and one fixed alpha."""
    joined = claims.join(table.select("estimand", "regime", "foil_alpha"), ["estimand", "regime"], "left")
    first = annotate_foil(joined, table_name, F.col("foil_alpha")).drop("foil_alpha")
    return annotate_foil(first, "fixed", F.lit(fixed))


def claim_rates(claims: DataFrame, keys: Sequence[str] = ("eps",)) -> DataFrame:
    """Counts and rates of each status: all, among expressed, per regime and pooled."""
    flags = []
    for s in STATUSES:
        hit = (F.col("status") == s).cast("double")
        flags += [F.count_if(F.col("status") == s).alias(f"{s}_count"), F.avg(hit).alias(f"{s}_rate")]
        if s != "outcome_unknown":
            flags.append(F.avg(F.when(F.col("effect_expressed"), hit)).alias(f"{s}_rate_expressed"))
    got = claims.groupingSets([[*keys, "regime"], [*keys]], *keys, "regime").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("effect_expressed").alias("expressed_n"), *flags,
        F.avg(F.col("activation_without_effect").cast("double")).alias("activation_without_effect_rate"),
        F.avg("spread").alias("mean_spread"), F.grouping("regime").alias("_g"),
    )
    return got.withColumn("scope", F.when(F.col("_g") == 1, "macro").otherwise(F.col("regime"))).drop("_g", "regime")


def summarize_claims(claims: DataFrame, keys: Sequence[str] = ("eps",), draws: int = 2000, seed: int = 7, foils: Sequence[str] = ()) -> DataFrame:
    """Bootstrap interval of every indicator, stratified by regime, long form."""
    items = [(s, (F.col("status") == s).cast("double")) for s in STATUSES]
    items += [(f"{s}_expressed", F.when(F.col("effect_expressed"), (F.col("status") == s).cast("double"))) for s in STATUSES[:3]]
    items += [(f"{f}_illegal", F.col(f"{f}_illegal_promotion").cast("double")) for f in foils]
    items += [("activation_without_effect", F.col("activation_without_effect").cast("double")), ("spread", F.col("spread"))]
    rows = F.array(*[F.struct(F.lit(n).alias("indicator"), c.alias("value")) for n, c in items])
    long = claims.select(*keys, *UNIT, F.inline(rows)).filter(F.col("value").isNotNull())
    return boot.stratified_bootstrap_mean(long, "value", ["regime"], [*keys, "indicator"], ["estimand", "scenario"], draws, seed)


def illegal_promotion_rate(claims: DataFrame, deltas: DataFrame, unit: Sequence[str] = ("regime", "scenario"), eps: float = 0.0) -> DataFrame:
    """Share of units where an arm's own direction would be promoted against the status."""
    got = deltas.join(claims.select(*unit, "status"), list(unit))
    flag = illegal_promotion(F.col("status"), point_direction(F.col("oracle_delta"), F.col("delta"), eps))
    return got.groupBy("arm").agg(F.avg(flag.cast("double")).alias("illegal_promotion_rate"), F.count(F.lit(1)).alias("n"))


def arm_columns() -> dict[str, float]:
    return {name: a for name, a in ARMS.items() if a is not None}
