"""Decision packets: licences, recommendation, checksum and replay, for whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..effects_names import GRID, POLICIES, PRIMARY_ESTIMAND
from . import claims as cl

# fixed values: licence kinds and reasons, recommended actions and the claims each one forbids
# fixed values: arm names and texts that packets carry
SEMANTIC_ARM = "vault_gated"
SCALAR_ARM = "scalar_semantic"
HOLD_ARM = "brain_at_hold"
ACTION_REASON = {
    "admit": "admit: kernel fires the vault-legal match",
    "hold_unresolved": "hold: Brain may select among vault-legal matches",
}
CLAIM_REASON = {
    "admit": "ensemble and oracle agree",
    "hold_unresolved": "residual signs disagree; directed effect is not licensed",
}
NOT_CALIBRATED = "real-network calibration"
FORBIDDEN = {
    "keep_baseline": [NOT_CALIBRATED],
    "adopt_semantic": ["scalar_semantic is the intervention policy", NOT_CALIBRATED],
    "act_under_hold": [
        "directed effect sign of semantic vs throughput", "MAE-lowest arm as the intervention policy", NOT_CALIBRATED,
    ],
    "withhold": ["any directed effect", NOT_CALIBRATED],
}
REQUIRED_FIELDS = (
    "schema", "id", "name", "operator_role", "decision", "horizon_s", "root_seed", "seed_mix", "baseline_policy",
    "semantic_policy", "estimand",
)
SEED_MIX = ("root_seed", "scenario", "replicate")


def action_licence(status: Column) -> Column:
    kind = F.when(status == "admit", "kernel").when(status == "hold_unresolved", "select").otherwise("withhold")
    reason = (
        F.when(status == "admit", ACTION_REASON["admit"]).when(status == "hold_unresolved", ACTION_REASON["hold_unresolved"])
        .otherwise(F.concat(status, F.lit(": park must refuse a rewrite")))
    )
    return F.struct(status.isin("admit", "hold_unresolved").alias("granted"), kind.alias("kind"), reason.alias("reason"))


def claim_licence(status: Column) -> Column:
    reason = (
        F.when(status == "admit", CLAIM_REASON["admit"]).when(status == "hold_unresolved", CLAIM_REASON["hold_unresolved"])
        .otherwise(F.concat(status, F.lit(": no directed-effect license")))
    )
    kind = F.when(status == "admit", "directed_effect").otherwise("none")
    return F.struct((status == "admit").alias("granted"), kind.alias("kind"), reason.alias("reason"))


def recommendation(status: Column, oracle_sign: Column) -> Column:
    action = (
        F.when((status == "admit") & (oracle_sign < 0), "keep_baseline").when((status == "admit") & (oracle_sign > 0), "adopt_semantic")
        .when(status == "hold_unresolved", "act_under_hold").otherwise("withhold")
    )
    arm = F.when(action == "keep_baseline", POLICIES[0]).when(action == "adopt_semantic", SEMANTIC_ARM).when(action == "act_under_hold", HOLD_ARM)
    banned = F.lit(None).cast("array<string>")
    for name, items in FORBIDDEN.items():
        banned = F.when(action == name, F.array(*[F.lit(i) for i in items])).otherwise(banned)
    return F.struct(action.alias("action"), arm.alias("arm"), banned.alias("do_not_claim"))


def with_licences(claims: DataFrame) -> DataFrame:
    s = F.col("status")
    return claims.withColumns({"action": action_licence(s), "claim": claim_licence(s), "recommendation": recommendation(s, F.col("oracle_sign"))})


def checksum(columns: Sequence[str]) -> Column:
    """sha256 of the compact JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def scenario_violations(scenarios: DataFrame, schema: str, seed_mix: Sequence[str] = SEED_MIX) -> DataFrame:
    """Add ``violation``: the first broken rule of the scenario contract, or null."""
    lacks = [c for c in REQUIRED_FIELDS if c not in scenarios.columns]
    if lacks:
        raise ValueError(f"scenario table is missing columns: {lacks}")
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_FIELDS]), lambda x: x.isNotNull())
    rule = (
        F.when(F.size(absent) > 0, F.concat(F.lit("missing required fields: "), F.array_join(absent, ",")))
        .when(F.col("schema") != schema, "the schema is another one")
        .when(F.col("seed_mix") != F.array(*[F.lit(s) for s in seed_mix]), "seed mix is refused")
        .when(F.col("semantic_policy") != SEMANTIC_ARM, "semantic_policy is not an intervention policy")
        .when(F.col("baseline_policy") != POLICIES[0], "baseline_policy is not the baseline")
        .when(F.col("estimand") != PRIMARY_ESTIMAND, "unsupported estimand")
        .when(~(F.col("horizon_s") > 0), "the horizon is not above zero")
    )
    return scenarios.withColumn("violation", rule)


PACKET = ("scenario_id", "name", "decision", "horizon_s", "root_seed", "regime", "status", "oracle_sign", "oracle_effect", "action", "claim", "recommendation", "approval")


def build_packets(scenarios: DataFrame, claims: DataFrame, schema: str, seed: int) -> DataFrame:
    """One packet per scenario, or a row whose ``rejected`` names why none is licensed.

    ``claims`` are stored claim rows (id, regime, effects_by_alpha, oracle_effect,
    eps, status, oracle_sign); each is scored again and must agree with itself.
    """
    checked = scenario_violations(scenarios, schema).withColumnRenamed("id", "scenario_id")
    stored = claims.withColumnRenamed("id", "scenario_id")
    keys = F.array_sort(F.map_keys("effects_by_alpha"))
    want = F.array(*[F.lit(f"{a:.2f}") for a in GRID])
    eps = F.col("eps")
    sign = cl.signed(F.col("oracle_effect"), eps)
    again = cl.status_of(sign, F.transform(F.map_values("effects_by_alpha"), lambda v: cl.signed(v, eps)))
    stored = stored.withColumn(
        "_bad",
        F.when(keys != want, "incomplete ensemble").when(again != F.col("status"), "the ensemble gives another status")
        .when(sign != F.col("oracle_sign"), "the ensemble gives another sign"),
    )
    got = checked.join(stored.drop("estimand"), "scenario_id", "left")
    got = got.withColumn(
        "rejected",
        F.coalesce(
            F.col("violation"), F.when(F.col("root_seed") != seed, "root_seed is not the confirmatory seed"),
            F.when(F.col("status").isNull(), "underidentified: scenario is not in the evaluation corpus"), F.col("_bad"),
        ),
    )
    got = with_licences(got).withColumn("approval", F.lit("pending"))
    return got.select(*PACKET, "rejected", F.when(F.col("rejected").isNull(), checksum(PACKET)).alias("checksum"))


def replay(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Compare stored packets with a rebuild; ``problem`` is null where all agree."""
    again = rebuilt.select("scenario_id", *[F.col(c).alias(f"_{c}") for c in ("action", "claim", "recommendation", "checksum")])
    s = stored.join(again, "scenario_id", "left").withColumn("_own", checksum(PACKET))
    problem = (
        F.when(F.col("checksum") != F.col("_own"), "packet checksum mismatch")
        .when(F.col("_checksum").isNull(), "packet cannot be rebuilt")
        .when((F.col("action") != F.col("_action")) | (F.col("claim") != F.col("_claim")), "the rebuild licenses otherwise")
        .when(F.col("recommendation") != F.col("_recommendation"), "the rebuild recommends otherwise")
    )
    return s.select("scenario_id", problem.alias("problem"))


def least_loaded(occurrences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per junction the occurrence of least load / max(capacity, 1), then least match id."""
    penalty = F.col("load") / F.greatest(F.col("capacity"), F.lit(1.0))
    got = occurrences.groupBy(*keys).agg(F.min(F.struct(penalty.alias("penalty"), "match_id")).alias("_b"))
    return got.select(*keys, F.col("_b.match_id").alias("match_id"), F.col("_b.penalty").alias("load_penalty"))


def junction_decision(junctions: DataFrame, occurrences: DataFrame, keys: Sequence[str] = ("junction",)) -> DataFrame:
    """kernel / select / withhold per junction.

    ``junctions``: keys, status; ``occurrences``: keys, match_id, load, capacity and
    ``admissible``.  Only admissible occurrences may be chosen.
    """
    legal = occurrences.filter("admissible")
    best = least_loaded(legal, keys)
    n = legal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("match_id").alias("_only"))
    j = junctions.join(best, list(keys), "left").join(n, list(keys), "left")
    s = F.col("status")
    pick = F.col("match_id").isNotNull()
    action = F.when(s == "admit", "kernel").when((s == "hold_unresolved") & pick, "select").otherwise("withhold")
    chosen = F.when((s == "admit") & (F.col("_n") == 1), F.col("_only")).when((s == "hold_unresolved") & pick, F.col("match_id"))
    return j.select(*keys, "status", action.alias("action"), chosen.alias("match_id"), F.when(action == "select", F.col("load_penalty")).alias("load_penalty"))


def rewrite_requests(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Accept a request only on hold, while matched and admissible; first failing reason wins.

    ``requests``: status, rule_id, match_id; ``current``: rule_id, match_id, admissible.
    """
    got = requests.join(current.select("rule_id", "match_id", "admissible"), ["rule_id", "match_id"], "left")
    reason = (
        F.when(F.col("status") != "hold_unresolved", F.concat(F.lit("claim status '"), F.col("status"), F.lit("' does not license Brain rewrite")))
        .when(F.col("admissible").isNull(), "there is no such match now")
        .when(~F.col("admissible"), "the match is not admissible")
    )
    return got.withColumn("outcome", F.when(reason.isNull(), "accepted").otherwise("refused")).withColumn("reason", reason).drop("admissible")
