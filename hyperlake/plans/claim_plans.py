"""Registered queries: claim scoring, foils, rates, licences and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..effects_names import STATUSES
from ..operators import claims as cl
from ..operators import effects as fx
from ..operators import packets as pk
from .bootstrap_plans import draws_sql, interval_sql
from .data import COUNTS, EFFECTS, METRICS, q6, r6, runs, table
from .registry import query

B, SEED, EPS = 200, 7, (0.0, 0.02)


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


ACT = """act AS (SELECT regime, scenario, """ + ", ".join(
    f"avg({c}) FILTER (policy = 'semantic') - avg({c}) FILTER (policy = 'throughput') AS {c}" for c in COUNTS
) + """ FROM runs WHERE model = 'oracle' GROUP BY ALL)"""
S = "CASE WHEN {0} > eps THEN 1 WHEN {0} < -eps THEN -1 ELSE 0 END"
CLAIMS = f"""{EFFECTS}, {ACT}, ens AS (SELECT estimand, regime, scenario, any_value(oracle_effect) AS oracle_effect, list(effect ORDER BY alpha) AS es FROM arm_errors GROUP BY ALL),
signs AS (SELECT *, {S.format('oracle_effect')} AS oracle_sign, list_transform(es, lambda x: {S.format('x')}) AS ss FROM ens, (VALUES (0.0::DOUBLE), (0.02::DOUBLE)) t(eps)),
claims AS (SELECT estimand, regime, scenario, eps, oracle_effect, oracle_sign, es, ss,
  CASE WHEN len(es) <> 4 THEN NULL WHEN oracle_sign = 0 THEN 'outcome_unknown' WHEN list_min(ss) <> list_max(ss) THEN 'hold_unresolved' WHEN list_max(ss) = 0 THEN 'reject'
       WHEN list_max(ss) = oracle_sign THEN 'admit' ELSE 'reject' END AS status,
  CASE WHEN len(es) <> 4 THEN NULL WHEN oracle_sign = 0 THEN 'oracle contrast not expressed' WHEN list_min(ss) <> list_max(ss) THEN 'residual signs disagree'
       WHEN list_max(ss) = 0 THEN 'ensemble silent while oracle expressed' WHEN list_max(ss) = oracle_sign THEN 'all hypotheses and oracle agree'
       ELSE 'ensemble agrees, disagrees with oracle' END AS notes,
  oracle_sign <> 0 AS effect_expressed, CASE WHEN len(es) = 4 THEN list_max(es) - list_min(es) END AS spread,
  (events <> 0 OR outages <> 0 OR handovers <> 0 OR reroutes <> 0) AS response_activation,
  (events <> 0 OR outages <> 0 OR handovers <> 0 OR reroutes <> 0) AND oracle_sign = 0 AS activation_without_effect
  FROM signs JOIN act USING (regime, scenario))"""


def claims(spark, sf):
    return cl.score_table(runs(spark, sf), METRICS, EPS)


@query("claims_score_table", f"""WITH {CLAIMS} SELECT estimand, regime, scenario, eps, {q6('oracle_effect')} AS oracle_effect, oracle_sign, status, notes, effect_expressed,
 response_activation, activation_without_effect, {q6('spread')} AS spread, {q6('es[2]')} AS effect_025, ss[4] AS sign_100 FROM claims""")
def score_table(spark, sf):
    c = claims(spark, sf).select(
        "estimand", "regime", "scenario", "eps", "oracle_effect", "oracle_sign", "status", "notes", "effect_expressed", "response_activation",
        "activation_without_effect", "spread", F.col("effects_by_alpha")["0.25"].alias("effect_025"), F.col("signs_by_alpha")["1.00"].alias("sign_100"))
    return rounded(c, "oracle_effect", "spread", "effect_025")


@query("claims_activation_contrast", f"WITH {EFFECTS}, {ACT} SELECT regime, scenario, {', '.join(f'{q6(c)} AS {c}' for c in COUNTS)}, (events <> 0 OR outages <> 0 OR handovers <> 0 OR reroutes <> 0) AS response_activation FROM act")
def activation(spark, sf):
    return rounded(cl.activation_contrast(runs(spark, sf)), *COUNTS)


@query("claims_incomplete_ensembles", f"""WITH {EFFECTS}, have AS (SELECT estimand, regime, scenario, list(alpha) AS h FROM arm_errors WHERE NOT (alpha = 0.5 AND scenario % 5 = 0) GROUP BY ALL)
SELECT estimand, regime, scenario, 1 AS n_missing, 0 AS n_extra FROM have WHERE NOT list_contains(h, 0.5)""")
def incomplete(spark, sf):
    e = fx.arm_abs_error(fx.scenario_effects(runs(spark, sf), METRICS)).filter(~((F.col("alpha") == 0.5) & (F.col("scenario") % 5 == 0)))
    return cl.incomplete_ensembles(e).select("estimand", "regime", "scenario", F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra"))


FOIL = """foil AS (SELECT DISTINCT estimand, regime, CASE WHEN estimand = 'goal_utility_ratio' THEN 0.25 WHEN regime = 'A' THEN 0.5 ELSE 0.0 END AS foil_alpha FROM effects),
pts AS (SELECT c.*, foil_alpha, es[CASE foil_alpha WHEN 0.0 THEN 1 WHEN 0.25 THEN 2 WHEN 0.5 THEN 3 ELSE 4 END] AS p, es[4] AS p1 FROM claims c JOIN foil USING (estimand, regime)),
dirs AS (SELECT *, CASE WHEN oracle_sign = 0 OR sp = 0 THEN 'unknown' WHEN sp = oracle_sign THEN 'match' ELSE 'mismatch' END AS td,
  CASE WHEN oracle_sign = 0 OR s1 = 0 THEN 'unknown' WHEN s1 = oracle_sign THEN 'match' ELSE 'mismatch' END AS fd
  FROM (SELECT *, """ + S.format("p") + " AS sp, " + S.format("p1") + " AS s1 FROM pts))"


def foils(spark, sf):
    c = claims(spark, sf)
    t = c.select("estimand", "regime").distinct().withColumn(
        "foil_alpha", F.when(F.col("estimand") == "goal_utility_ratio", 0.25).when(F.col("regime") == "A", 0.5).otherwise(0.0))
    return cl.annotate_foils(c, t)


@query("claims_foils", f"""WITH {CLAIMS}, {FOIL} SELECT estimand, regime, scenario, eps, foil_alpha::DOUBLE AS table_alpha, td AS table_direction, td = 'match' AND status IN ('hold_unresolved', 'reject') AS table_illegal_promotion,
 1.0::DOUBLE AS fixed_alpha, fd AS fixed_direction, fd = 'match' AND status IN ('hold_unresolved', 'reject') AS fixed_illegal_promotion FROM dirs""")
def annotate(spark, sf):
    cols = [f"{n}_{s}" for n in ("table", "fixed") for s in ("alpha", "direction", "illegal_promotion")]
    return foils(spark, sf).select("estimand", "regime", "scenario", "eps", *cols)


RATES = ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}_count, {q6(f'''avg((status = '{s}')::INT)''')} AS {s}_rate"
    + ("" if s == "outcome_unknown" else f""", {q6(f"avg((status = '{s}')::INT) FILTER (effect_expressed)")} AS {s}_rate_expressed""")
    for s in STATUSES
)


@query("claims_rates", f"""WITH {CLAIMS} SELECT eps, coalesce(regime, 'macro') AS scope, count(*) AS n, count(*) FILTER (effect_expressed) AS expressed_n, {RATES},
 {q6('avg(activation_without_effect::INT)')} AS activation_without_effect_rate, {q6('avg(spread)')} AS mean_spread FROM claims GROUP BY GROUPING SETS ((eps, regime), (eps))""")
def rates(spark, sf):
    got = cl.claim_rates(claims(spark, sf))
    return rounded(got, *[c for c in got.columns if "rate" in c or c == "mean_spread"])


_LONG = "UNION ALL ".join(
    [f"SELECT eps, estimand, regime, scenario, '{s}' AS indicator, (status = '{s}')::INT::DOUBLE AS v FROM claims " for s in STATUSES]
    + [f"SELECT eps, estimand, regime, scenario, '{s}_expressed', (status = '{s}')::INT::DOUBLE FROM claims WHERE effect_expressed " for s in STATUSES[:3]]
    + ["SELECT eps, estimand, regime, scenario, 'activation_without_effect', activation_without_effect::INT::DOUBLE FROM claims ",
       "SELECT eps, estimand, regime, scenario, 'spread', spread FROM claims "]
)
K = ["eps", "indicator"]


@query("claims_summary_bootstrap", f"""WITH {CLAIMS}, ind AS ({_LONG}), {draws_sql('ind', 'v', [*K, 'regime'], ['estimand', 'scenario'], K)}
SELECT eps, indicator, {q6('mean')} AS mean, {q6('lo')} AS lo, {q6('hi')} AS hi, n FROM (SELECT eps, indicator, avg(v) AS mean, count(*) AS n FROM ind GROUP BY ALL) JOIN ({interval_sql(K)}) USING (eps, indicator)""")
def summary(spark, sf):
    return rounded(cl.summarize_claims(claims(spark, sf), draws=B, seed=SEED), "mean", "lo", "hi")


@query("claims_illegal_promotion_rate", f"""WITH {CLAIMS}, d AS (SELECT regime, scenario, model AS arm, effect AS delta, oracle_effect AS od FROM arm_errors WHERE estimand = 'goal_utility_ratio'),
j AS (SELECT d.*, status, CASE WHEN od = 0 OR delta = 0 THEN 'unknown' WHEN sign(od) = sign(delta) THEN 'match' ELSE 'mismatch' END AS dir FROM d JOIN claims USING (regime, scenario) WHERE eps = 0 AND estimand = 'goal_utility_ratio')
SELECT arm, {q6("avg((dir = 'match' AND status IN ('hold_unresolved', 'reject'))::INT)")} AS illegal_promotion_rate, count(*) AS n FROM j GROUP BY arm""")
def illegal(spark, sf):
    c = claims(spark, sf).filter("eps = 0 AND estimand = 'goal_utility_ratio'")
    d = fx.arm_abs_error(fx.scenario_effects(runs(spark, sf), METRICS[:1])).select(
        "regime", "scenario", F.col("model").alias("arm"), F.col("effect").alias("delta"), F.col("oracle_effect").alias("oracle_delta"))
    return rounded(cl.illegal_promotion_rate(c, d), "illegal_promotion_rate")


KIND = "CASE status WHEN 'admit' THEN '{}' WHEN 'hold_unresolved' THEN '{}' WHEN 'reject' THEN '{}' ELSE '{}' END"
RECOMMEND = """CASE WHEN status = 'admit' AND oracle_sign < 0 THEN 'keep_baseline' WHEN status = 'admit' THEN 'adopt_semantic'
 WHEN status = 'hold_unresolved' THEN 'act_under_hold' ELSE 'withhold' END"""


@query("packets_licences", f"""WITH {CLAIMS} SELECT estimand, regime, scenario, {KIND.format('kernel', 'select', 'withhold', 'withhold')} AS action_kind,
 {KIND.format('directed_effect', 'none', 'none', 'none')} AS claim_kind, {RECOMMEND} AS recommended, status IN ('admit', 'hold_unresolved') AS action_granted FROM claims WHERE eps = 0""")
def licences(spark, sf):
    c = pk.with_licences(claims(spark, sf).filter("eps = 0"))
    return c.select("estimand", "regime", "scenario", F.col("action.kind").alias("action_kind"), F.col("claim.kind").alias("claim_kind"),
                    F.col("recommendation.action").alias("recommended"), F.col("action.granted").alias("action_granted"))


SCHEMA, ROOT = "scenario_v1", 260826


def scenarios(spark, sf):
    """One decision scenario per customer; a few break the contract."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.lit(SCHEMA).alias("schema"), k.alias("id"), F.col("c_name").alias("name"), F.lit("operator").alias("operator_role"), F.col("c_mktsegment").alias("decision"),
        F.when(k % 11 == 0, 0.0).otherwise(22.0).alias("horizon_s"), F.when(k % 13 == 0, 1).otherwise(ROOT).alias("root_seed"),
        F.array(*[F.lit(s) for s in pk.SEED_MIX]).alias("seed_mix"), F.lit("throughput").alias("baseline_policy"),
        F.when(k % 17 == 0, "scalar_semantic").otherwise("vault_gated").alias("semantic_policy"), F.lit("goal_utility_ratio").alias("estimand"))


def stored_claims(spark, sf):
    """Claims of customers from their account balance and order totals, one per customer with orders."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    e = [F.col("m") - 250000, F.col("m") - 252000, F.col("m") - 248000, F.col("m") - 245000]
    claim = c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("regime"), F.col("c_acctbal").alias("oracle_effect"),
        F.lit("goal_utility_ratio").alias("estimand"),
        F.create_map(*[x for a, v in zip(("0.00", "0.25", "0.50", "1.00"), e) for x in (F.lit(a), v)]).alias("effects_by_alpha"), F.lit(True).alias("response_activation"))
    status = F.when(F.col("id") % 19 == 0, "admit").otherwise(F.col("status"))
    return cl.score(claim).select("id", "regime", "oracle_effect", "eps", "estimand", "effects_by_alpha", "oracle_sign", status.alias("status"))


STORED = """st AS (SELECT c_custkey AS id, c_acctbal AS oe, CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal < 0 THEN -1 ELSE 0 END AS os,
  [sign(m - 250000), sign(m - 252000), sign(m - 248000), sign(m - 245000)] AS ss FROM customer JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey),
true_st AS (SELECT *, CASE WHEN os = 0 THEN 'outcome_unknown' WHEN list_min(ss) <> list_max(ss) THEN 'hold_unresolved' WHEN list_max(ss) = 0 THEN 'reject' WHEN list_max(ss) = os THEN 'admit' ELSE 'reject' END AS real_status FROM st),
stored AS (SELECT *, CASE WHEN id % 19 = 0 THEN 'admit' ELSE real_status END AS status FROM true_st),
packets AS (SELECT c_custkey AS scenario_id, status, os AS oracle_sign,
  CASE WHEN c_custkey % 17 = 0 THEN 'semantic_policy is not an intervention policy' WHEN c_custkey % 11 = 0 THEN 'the horizon is not above zero'
   WHEN c_custkey % 13 = 0 THEN 'root_seed is not the confirmatory seed' WHEN id IS NULL THEN 'underidentified: scenario is not in the evaluation corpus'
   WHEN real_status <> status THEN 'the ensemble gives another status' END AS rejected FROM customer LEFT JOIN stored ON c_custkey = id)"""


def packets(spark, sf):
    return pk.build_packets(scenarios(spark, sf), stored_claims(spark, sf), SCHEMA, ROOT)


@query("packets_build", f"WITH {STORED} SELECT scenario_id, status, rejected, rejected IS NULL AS has_checksum, CASE WHEN status IS NOT NULL THEN {RECOMMEND} ELSE 'withhold' END AS recommended FROM packets")
def build(spark, sf):
    return packets(spark, sf).select("scenario_id", "status", "rejected", F.col("checksum").isNotNull().alias("has_checksum"), F.col("recommendation.action").alias("recommended"))


@query("packets_replay", f"""WITH {STORED} SELECT scenario_id, CASE WHEN scenario_id % 5 = 0 THEN 'packet checksum mismatch' END AS problem FROM packets WHERE rejected IS NULL""")
def replay(spark, sf):
    built = packets(spark, sf).filter("rejected IS NULL")
    forged = built.withColumn("oracle_effect", F.when(F.col("scenario_id") % 5 == 0, F.col("oracle_effect") + 1).otherwise(F.col("oracle_effect")))
    return pk.replay(forged, built)


OCC = """occ AS (SELECT l_orderkey AS junction, l_partkey || ':' || l_suppkey || ':' || l_linenumber AS match_id, l_quantity AS load, p_size::DOUBLE AS capacity, l_returnflag <> 'R' AS admissible
 FROM lineitem JOIN part ON l_partkey = p_partkey),
jn AS (SELECT o_orderkey AS junction, CASE o_orderstatus WHEN 'F' THEN 'hold_unresolved' WHEN 'O' THEN 'admit' ELSE 'reject' END AS status FROM orders)"""


def occurrences(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("junction"), F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber").alias("match_id"),
        F.col("l_quantity").alias("load"), F.col("p_size").cast("double").alias("capacity"), (F.col("l_returnflag") != "R").alias("admissible"))


def junctions(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "hold_unresolved").when(F.col("o_orderstatus") == "O", "admit").otherwise("reject")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("junction"), status.alias("status"))


@query("junction_least_loaded", f"WITH {OCC} SELECT junction, match_id, {q6('pen')} AS load_penalty FROM (SELECT *, load / greatest(capacity, 1) AS pen, row_number() OVER (PARTITION BY junction ORDER BY load / greatest(capacity, 1), match_id) AS rn FROM occ WHERE admissible) WHERE rn = 1")
def least_loaded(spark, sf):
    return rounded(pk.least_loaded(occurrences(spark, sf).filter("admissible"), ["junction"]), "load_penalty")


@query("junction_decision", f"""WITH {OCC}, b AS (SELECT junction, count(*) AS k, min(match_id) AS single, min_by(match_id, (load / greatest(capacity, 1), match_id)) AS best FROM occ WHERE admissible GROUP BY junction)
SELECT junction, status, CASE WHEN status = 'admit' THEN 'kernel' WHEN status = 'hold_unresolved' AND best IS NOT NULL THEN 'select' ELSE 'withhold' END AS action,
 CASE WHEN status = 'admit' AND k = 1 THEN single WHEN status = 'hold_unresolved' THEN best END AS match_id FROM jn LEFT JOIN b USING (junction)""")
def decision(spark, sf):
    return pk.junction_decision(junctions(spark, sf), occurrences(spark, sf)).drop("load_penalty")


@query("junction_rewrite_requests", f"""WITH {OCC}, cur AS (SELECT junction, match_id, bool_or(admissible) AS admissible FROM occ GROUP BY ALL),
 req AS (SELECT l_orderkey AS junction, l_partkey || ':' || l_suppkey || ':' || (l_linenumber % 6) AS match_id, status FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem) JOIN jn ON l_orderkey = junction)
SELECT junction, match_id, status, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS outcome, reason FROM (
 SELECT r.*, CASE WHEN status <> 'hold_unresolved' THEN concat('claim status ', chr(39), status, chr(39), ' does not license Brain rewrite') WHEN admissible IS NULL THEN 'there is no such match now'
  WHEN NOT admissible THEN 'the match is not admissible' END AS reason FROM req r LEFT JOIN cur USING (junction, match_id))""")
def requests(spark, sf):
    cur = occurrences(spark, sf).groupBy(F.col("junction").alias("rule_id"), "match_id").agg(F.bool_or("admissible").alias("admissible"))
    req = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct().select(
        F.col("l_orderkey").alias("rule_id"), F.concat_ws(":", "l_partkey", "l_suppkey", F.col("l_linenumber") % 6).alias("match_id"))
    req = req.join(junctions(spark, sf).withColumnRenamed("junction", "rule_id"), "rule_id")
    return pk.rewrite_requests(req, cur).withColumnRenamed("rule_id", "junction")
