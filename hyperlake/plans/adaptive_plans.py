"""Registered queries: ordered recursive statistics, projections, expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import adaptive as ad
from ..operators import outage as outages
from .data import q6, r6, table
from .event_data import BASE, WHOLE, base, whole_log
from .registry import query

K, O = ["user_id"], ["t", "event_id"]
SERIES = BASE + ", sr AS (SELECT user_id, list(value ORDER BY t, event_id) AS l, count(*) AS n FROM base GROUP BY user_id)"


@query("adaptive_eligibility_trace", f"""WITH {BASE}, f AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id)) / 86400 AS g FROM base)
SELECT user_id, event_id, {q6('exp(-g) * sum(exp(g) * value) OVER (PARTITION BY user_id ORDER BY t, event_id)', 5)} AS trace FROM f""")
def trace(spark, sf):
    return ad.eligibility_trace(base(spark, sf), K, "t", "value", 86400.0).select("user_id", "event_id", r6("trace", 5).alias("trace"))


@query("adaptive_load_level", f"""WITH {SERIES}, e AS (SELECT user_id, list_reduce(l, lambda a, x: 0.35 * x + 0.65 * a) AS e FROM sr)
SELECT user_id, {q6('e', 5)} AS smoothed, greatest(0, least(60, round_even(e, 0)))::INT AS load FROM e""")
def load_level(spark, sf):
    return ad.load_level(base(spark, sf), K, O, "value", 0.35, 60).withColumn("smoothed", r6("smoothed", 5))


@query("adaptive_ema_series", f"WITH {SERIES} SELECT user_id, n, {q6('list_reduce(l, lambda a, x: 0.1 * x + 0.9 * a)', 5)} AS last_ema FROM sr")
def ema(spark, sf):
    got = ad.ema_series(base(spark, sf), K, O, "value", 0.1)
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max_by("ema", F.struct(*O)), 5).alias("last_ema"))


@query("adaptive_fit_ema_alpha", f"""WITH {SERIES}, a AS (SELECT user_id, n, round(0.05 + 0.05 * i, 2) AS alpha, l FROM sr, range(18) r(i)),
 m AS (SELECT user_id, n, alpha, list_reduce(list_transform(l, lambda x: {{'p': x, 's': 0.0::DOUBLE}}), lambda c, x: {{'p': alpha * x.p + (1 - alpha) * c.p, 's': c.s + (c.p - x.p)^2}}).s / (n - 1) AS mse FROM a)
SELECT user_id, n, CASE WHEN n < 3 THEN 0.35 ELSE min_by(alpha, (mse, alpha)) END::DOUBLE AS alpha, {q6('min(mse)', 4)} AS mse FROM m GROUP BY user_id, n""")
def fit(spark, sf):
    return ad.fit_ema_alpha(base(spark, sf), K, O, "value").withColumn("mse", r6("mse", 4))


@query("adaptive_robbins_monro", f"WITH {BASE} SELECT user_id, event_id, {q6('0.5 + 0.01 * sum(value - 50) OVER (PARTITION BY user_id ORDER BY t, event_id)', 5)} AS theta FROM base")
def robbins(spark, sf):
    b = base(spark, sf).withColumn("err", F.col("value") - 50)
    return ad.robbins_monro(b, K, O, "err", 0.01, 0.5).select("user_id", "event_id", r6("theta", 5).alias("theta"))


CUS = SERIES.replace("list(value ORDER", "list(least(value / 100, 1.2) ORDER") + """, h AS (SELECT user_id, l, l[-1] AS last, list_avg(l[1:greatest(1, n // 2)]) AS m FROM sr),
 c AS (SELECT *, list_reduce(list_transform(l, lambda x: {'a': x, 'b': 0.0::DOUBLE}), lambda s, x: {'a': greatest(0.0, s.a - (x.a - m + 0.15)), 'b': greatest(s.b, greatest(0.0, s.a - (x.a - m + 0.15)))}, {'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}) AS r FROM h)"""


@query("adaptive_cusum_outage", f"""WITH {CUS} SELECT user_id, {q6('last', 5)} AS last, {q6('r.b', 5)} AS cusum, CASE WHEN last <= 0 THEN false WHEN last >= 0.99 THEN true WHEN last < 0.45 THEN false ELSE r.b <= 1.25 END AS available FROM c""")
def cusum(spark, sf):
    b = base(spark, sf).withColumn("x", F.least(F.col("value") / 100, F.lit(1.2)))
    return ad.cusum_outage(b, K, O, "x").select("user_id", r6("last", 5).alias("last"), r6("cusum", 5).alias("cusum"), "available")


@query("adaptive_prefix_series", f"WITH {BASE} SELECT user_id, event_id, {q6('avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id)', 9)} AS prefix_mean FROM base")
def prefix(spark, sf):
    return ad.prefix_series(base(spark, sf), K, O, "value").select("user_id", "event_id", r6("prefix_mean", 9).alias("prefix_mean"))


@query("adaptive_project_constraints", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS strict_value, c_acctbal < 0 AS strict_rejected, greatest(c_acctbal, 0.0) AS nonnegative, least(greatest(c_acctbal, 10.0), 5000.0) AS bounded,
 least(greatest(c_acctbal / 5000, 0), 1)::DOUBLE AS probability FROM customer""")
def project(spark, sf):
    x = F.col("c_acctbal")
    s = ad.project(x, "nonnegative")
    return table(spark, sf, "customer").select(
        "c_custkey", s["value"].alias("strict_value"), s["rejected"].alias("strict_rejected"), ad.project(x, "nonnegative", "project")["value"].alias("nonnegative"),
        ad.project(x, "bounded", "project", 10.0, 5000.0)["value"].alias("bounded"), ad.project(x / 5000, "probability", "project")["value"].alias("probability"))


@query("adaptive_scheduled_assignments", f"""WITH {BASE}, u AS (SELECT user_id, t, event_id, CASE WHEN event_type = 'signup' THEN value END AS rate, CASE WHEN event_type = 'purchase' THEN value / 2 END AS gain FROM base),
 l AS (SELECT b.user_id, b.event_id, b.event_type, last_value(u.rate IGNORE NULLS) OVER w AS rate, last_value(u.gain IGNORE NULLS) OVER w AS gain FROM base b JOIN u USING (user_id, event_id) WINDOW w AS (PARTITION BY b.user_id ORDER BY b.t, b.event_id))
SELECT user_id, event_id, {q6('coalesce(rate, 1.0)')} AS rate, {q6('coalesce(gain, 0.5)')} AS gain FROM l WHERE event_type IN ('click', 'view', 'error')""")
def scheduled(spark, sf):
    b = base(spark, sf)
    ups = b.filter(F.col("event_type").isin("signup", "purchase")).select(
        "user_id", "t", F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "signup", "rate").otherwise("gain").alias("parameter"),
        F.when(F.col("event_type") == "signup", F.col("value")).otherwise(F.col("value") / 2).alias("value"))
    ev = b.filter(F.col("event_type").isin("click", "view", "error")).select("user_id", "t", "event_id")
    got = ad.scheduled_assignments(ev, ups, K, {"rate": 1.0, "gain": 0.5})
    return got.select("user_id", "event_id", r6("rate").alias("rate"), r6("gain").alias("gain"))


#: availability between the two bounds for most rows: high and low spells with some noise, a few rows at the bounds
SPELLS = f"""{BASE}, spell AS (SELECT user_id, t, event_id, CASE WHEN event_id % 97 = 0 THEN 0.0 WHEN event_id % 89 = 0 THEN 1.0 ELSE CASE WHEN floor(t / 432000)::BIGINT % 2 = 0 THEN 0.92 ELSE 0.58 END + (event_id % 10) / 200 END AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM base),
 heads AS (SELECT a.user_id, a.n, any_value(a.x) AS x, any_value(a.t) AS t, any_value(a.event_id) AS event_id, avg(b.x) FILTER (b.n <= greatest(1, a.n // 2)) AS m FROM spell a JOIN spell b ON b.user_id = a.user_id AND b.n <= a.n GROUP BY a.user_id, a.n),
 runs AS (SELECT h.user_id, h.n, b.n AS j, sum(h.m - 0.15 - b.x) OVER (PARTITION BY h.user_id, h.n ORDER BY b.n) AS p FROM heads h JOIN spell b ON b.user_id = h.user_id AND b.n <= h.n),
 drops AS (SELECT user_id, n, max(d) AS cusum FROM (SELECT user_id, n, p - least(0, min(p) OVER (PARTITION BY user_id, n ORDER BY j)) AS d FROM runs) GROUP BY user_id, n),
 avail AS (SELECT h.*, CASE WHEN x <= 0 THEN false WHEN x >= 0.99 THEN true WHEN x < 0.45 THEN false ELSE cusum <= 1.25 END AS available FROM heads h JOIN drops USING (user_id, n))"""


def spells(b):
    """The same series from a table or a stream of events."""
    spell = F.when(F.floor(F.col("t") / 432000) % 2 == 0, 0.92).otherwise(0.58) + (F.col("event_id") % 10) / 200
    return b.select("user_id", "t", "event_id", F.when(F.col("event_id") % 97 == 0, 0.0).when(F.col("event_id") % 89 == 0, 1.0).otherwise(spell).alias("x"))


@query("adaptive_outage_prefix", f"WITH {SPELLS} SELECT user_id, event_id, available FROM avail")
def outage_prefix(spark, sf):
    return outages.outage_prefix(spells(base(spark, sf)), K, O, "x").select("user_id", "event_id", "available")


@query("expression_functions", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {q6('least(greatest(l_quantity, 10), 20)')} AS clipped, {q6('ln(1 + exp(l_discount))')} AS soft, round_even(l_extendedprice / 1000, 0)::DOUBLE AS rounded,
 l_tax BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('A', 'N') AS chosen, {q6('CASE WHEN l_quantity > 25 THEN tanh(l_discount) ELSE sqrt(l_tax) END')} AS branch, floor(l_extendedprice / 7)::BIGINT AS whole, {q6('l_quantity % 7')} AS rest FROM lineitem""")
def functions(spark, sf):
    li = table(spark, sf, "lineitem")
    e = lambda text: ex.checked(text, li.columns)
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(e("clip(l_quantity, 10, 20)")).alias("clipped"), r6(e("softplus(l_discount)")).alias("soft"), e("round(l_extendedprice / 1000)").cast("double").alias("rounded"),
        e("l_tax between 0.02d and 0.05d and l_returnflag in ('A', 'N')").alias("chosen"), r6(e("case when l_quantity > 25 then tanh(l_discount) else sqrt(l_tax) end")).alias("branch"),
        e("floor(l_extendedprice / 7)").alias("whole"), r6(e("l_quantity % 7")).alias("rest"))


@query("expression_operators", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity >= 25 AND l_tax <> 0.05 AS kept, floor(l_extendedprice / 7)::BIGINT * 2 AS floored, {q6('-(l_discount ** 2) + 2 ** -1')} AS power,
 CASE WHEN l_quantity > 40 THEN 'many' WHEN l_quantity <= 5 THEN 'few' ELSE 'some' END AS size_class, 10 < l_quantity AND l_quantity <= 30 AS chained, l_returnflag NOT IN ('A', 'R') AS fresh,
 CAST(l_quantity AS INT) // 4 AS quarters, l_returnflag || '-' || l_linestatus AS flags, l_shipdate IS NOT NULL AS known FROM lineitem""")
def operators(spark, sf):
    li = table(spark, sf, "lineitem")
    e = lambda text: ex.checked(text, li.columns)
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", e("l_quantity >= 25 and l_tax != 0.05d").alias("kept"), e("l_extendedprice // 7 * 2").alias("floored"), r6(e("-l_discount ** 2 + 2 ** -1")).alias("power"),
        e("'many' if l_quantity > 40 else 'few' if l_quantity <= 5 else 'some'").alias("size_class"), e("10 < l_quantity <= 30").alias("chained"), e("l_returnflag not in ['A', 'R']").alias("fresh"),
        e("cast(l_quantity as int) // 4").alias("quarters"), e("l_returnflag || '-' || l_linestatus").alias("flags"), e("l_shipdate is not None").alias("known"))


@query("expression_dead_zone_sign", "SELECT c_custkey, CASE WHEN c_acctbal > 100 THEN 1 WHEN c_acctbal < -100 THEN -1 ELSE 0 END AS sign FROM customer")
def sign(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", ex.dead_zone_sign(F.col("c_acctbal"), 100.0).alias("sign"))


@query("expression_entity_ids", """SELECT o_orderkey, lower(printf('%016x', o_custkey)) || ':' || lower(printf('%016x', o_orderkey)) AS id, o_custkey AS namespace, o_orderkey AS counter FROM orders""")
def entity_ids(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", ex.entity_id(F.col("o_custkey"), F.col("o_orderkey")).alias("id"))
    p = ex.parse_entity_id(F.col("id"))
    return o.select("o_orderkey", "id", p["namespace"].alias("namespace"), p["counter"].alias("counter"))


@query("expression_changed_paths", f"WITH {WHOLE} SELECT event_id, list_filter([CASE WHEN k % 3 = 0 THEN 'gain' END, 'new', CASE WHEN k % 2 = 0 THEN 'rate' END], lambda x: x IS NOT NULL) AS changed FROM whole")
def changed(spark, sf):
    lg = whole_log(spark, sf)
    before = F.create_map(F.lit("rate"), F.col("value"), F.lit("gain"), F.lit(1.0))
    after = F.create_map(F.lit("rate"), F.when(F.col("k") % 2 == 0, F.col("value") + 1).otherwise(F.col("value")), F.lit("gain"), F.when(F.col("k") % 3 == 0, 2.0).otherwise(1.0), F.lit("new"), F.lit(0.0))
    return lg.select("event_id", ex.changed_paths(before, after).alias("changed"))


@query("expression_content_hash", "SELECT count(DISTINCT (p_brand, p_size, p_type)) AS distinct_contents, count(*) AS rows FROM part")
def content_hash(spark, sf):
    h = ex.content_hash(["p_brand", "p_size", "p_type"])
    return table(spark, sf, "part").select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("distinct_contents"), F.sum("c").alias("rows"))
