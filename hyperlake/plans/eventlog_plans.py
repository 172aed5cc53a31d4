"""Registered queries: event logs, causality, likelihood, ledgers, weighted choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eventlog as el
from ..operators import inventory as inv
from ..operators.bootstrap import hashed
from .data import q6, r6, table
from .event_data import BASE, LOG, WHOLE, base, log, whole_log
from .registry import query


@query("eventlog_deterministic_order", f"""WITH {BASE}, q AS (SELECT user_id AS run_id, floor(t / 86400)::DOUBLE AS t, CASE event_type WHEN 'error' THEN 'external' WHEN 'purchase' THEN 'adaptation' ELSE 'meta' END AS kind, k AS namespace, event_id AS sequence FROM base WHERE event_type IN ('error', 'purchase', 'signup'))
SELECT run_id, t, kind, sequence, row_number() OVER (PARTITION BY run_id ORDER BY t, CASE kind WHEN 'external' THEN 0 WHEN 'adaptation' THEN 1 ELSE 2 END, namespace, sequence) - 1 AS event_index FROM q""")
def order(spark, sf):
    b = base(spark, sf)
    queue = lambda et, kind: b.filter(F.col("event_type") == et).select(
        F.col("user_id").alias("run_id"), F.floor(F.col("t") / 86400).cast("double").alias("t"), F.lit(kind).alias("kind"), F.col("k").alias("namespace"), F.col("event_id").alias("sequence"))
    got = el.event_order(queue("error", "external"), queue("purchase", "adaptation"), queue("signup", "meta"))
    return got.select("run_id", "t", "kind", "sequence", "event_index")


@query("eventlog_order_violations", f"""WITH {LOG}, s AS (SELECT run_id, CASE WHEN event_id % 40 = 0 THEN event_index + 1000 ELSE event_index END AS event_index, CASE WHEN event_id % 30 = 0 THEN t - 1e6 ELSE t END AS t FROM log),
 p AS (SELECT *, lag(t) OVER w AS pt, lag(event_index) OVER w AS pi FROM s WINDOW w AS (PARTITION BY run_id ORDER BY event_index))
SELECT run_id, event_index, CASE WHEN t < pt THEN 'time_decreases' ELSE 'index_gap' END AS code FROM p WHERE t < pt OR event_index <> pi + 1""")
def order_violations(spark, sf):
    broken = log(spark, sf).withColumns({
        "event_index": F.when(F.col("event_id") % 40 == 0, F.col("event_index") + 1000).otherwise(F.col("event_index")),
        "t": F.when(F.col("event_id") % 30 == 0, F.col("t") - 1e6).otherwise(F.col("t"))})
    return el.order_violations(broken)


@query("eventlog_hash_chain_violations", f"WITH {LOG} SELECT run_id, event_index, 'broken_hash_chain' AS code FROM log WHERE event_index > 0 AND event_id % 25 = 0")
def hash_chain(spark, sf):
    h = lambda i: F.sha2(F.concat_ws("|", F.col("run_id"), i), 256)
    lg = log(spark, sf)
    lg = lg.withColumn("pre_state_hash", F.when(F.col("event_id") % 25 == 0, "forged").otherwise(h(F.col("event_index")))).withColumn("post_state_hash", h(F.col("event_index") + 1))
    return el.hash_chain_violations(lg)


def _records(spark, sf):
    u = lambda c: F.concat(F.lit("u:"), F.col(c).cast("string"))
    empty = F.create_map().cast("map<string,string>")
    lg = whole_log(spark, sf)
    kind = F.when(F.col("event_type").isin("click", "view"), "internal").when(F.col("event_type") == "error", "external").otherwise("adaptation")
    ev = lg.select(
        "run_id", "event_index", "event_id", kind.alias("kind"), F.create_map(F.lit("a"), u("user_id"), F.lit("b"), u("k")).alias("vertex_map"), empty.alias("edge_map"), u("k").alias("bound_vertex"),
        F.create_map(F.lit("rate"), F.col("value"), F.lit("gain"), F.lit(1.0)).alias("parameter_before"),
        F.create_map(F.lit("rate"), F.when(F.col("k") % 2 == 0, F.col("value")).otherwise(F.col("value") + 1), F.lit("gain"), F.lit(1.0)).alias("parameter_after"),
        F.create_map(F.lit("z"), F.lit(0.0)).alias("memory_before"), F.create_map(F.lit("z"), F.lit(0.0)).alias("memory_after"))
    deltas = lg.filter(F.col("event_type") != "signup").select("run_id", "event_index", u("user_id").alias("entity_id"))
    return ev, deltas


PRINTS = WHOLE + """, prints AS (SELECT run_id, event_index, event_id, unnest(['u:' || user_id, 'u:' || k]) AS entity, 'read' AS mode FROM whole WHERE event_type IN ('click', 'view')
 UNION SELECT run_id, event_index, event_id, 'u:' || k, 'read' FROM whole WHERE event_type = 'error' UNION SELECT run_id, event_index, event_id, 'u:' || user_id, 'write' FROM whole WHERE event_type <> 'signup'
 UNION SELECT run_id, event_index, event_id, 'parameters.rate', 'write_path' FROM whole WHERE k % 2 <> 0)"""


@query("eventlog_footprint", f"WITH {PRINTS} SELECT * FROM prints")
def footprint(spark, sf):
    return el.footprint(*_records(spark, sf))


TOUCH = PRINTS + """, touch AS (SELECT run_id, entity, event_index, event_id, bool_or(mode <> 'read') AS w FROM prints GROUP BY ALL),
 lw AS (SELECT *, last_value(CASE WHEN w THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id, entity ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM touch)"""


@query("eventlog_last_writer", f"WITH {TOUCH} SELECT entity, event_id, w, writer FROM lw")
def last_writer(spark, sf):
    return el.last_writer(el.footprint(*_records(spark, sf))).select("entity", "event_id", "w", "writer")


@query("eventlog_causal_edges", f"WITH {TOUCH} SELECT DISTINCT run_id, writer AS cause, event_id AS effect FROM lw WHERE writer IS NOT NULL AND writer <> event_id")
def causal(spark, sf):
    return el.causal_edges(el.footprint(*_records(spark, sf)))


DAILY = BASE + """, daily AS (SELECT user_id || '-' || floor(t / 86400)::BIGINT AS run_id, event_id, row_number() OVER (PARTITION BY user_id, floor(t / 86400) ORDER BY t, event_id) AS i FROM base),
 e AS (SELECT a.run_id, a.event_id AS cause, b.event_id AS effect FROM daily a JOIN daily b ON a.run_id = b.run_id AND (b.i = a.i + 1 OR b.i = a.i + 3)),
 tg AS (SELECT run_id, max_by(event_id, i) AS target, min_by(event_id, i) AS root FROM daily GROUP BY run_id)"""


def _daily(spark, sf):
    from .. import ordered

    b = base(spark, sf).select(F.concat_ws("-", "user_id", F.floor(F.col("t") / 86400)).alias("run_id"), "event_id", "t")
    d = ordered.scan(b, ["run_id"], ["t", "event_id"], {"i": ordered.rnumber()}).drop("t")
    nxt = d.withColumn("i", F.explode(F.array(F.col("i") + 1, F.col("i") + 3))).withColumnRenamed("event_id", "cause")
    edges = nxt.join(d.withColumnRenamed("event_id", "effect"), ["run_id", "i"]).select("run_id", "cause", "effect")
    ends = d.groupBy("run_id").agg(F.max_by("event_id", "i").alias("target"), F.min_by("event_id", "i").alias("root"))
    return edges, ends


@query("eventlog_ancestors", f"WITH RECURSIVE {DAILY}, r AS (SELECT tg.run_id, target, cause AS event_id FROM tg JOIN e ON e.run_id = tg.run_id AND e.effect = target UNION SELECT r.run_id, target, cause FROM r JOIN e ON e.run_id = r.run_id AND e.effect = r.event_id) SELECT * FROM r")
def ancestors(spark, sf):
    edges, ends = _daily(spark, sf)
    return el.reachable(edges, ends.select("run_id", F.col("target").alias("event_id")))


@query("eventlog_descendants", f"WITH RECURSIVE {DAILY}, r AS (SELECT tg.run_id, root AS target, effect AS event_id FROM tg JOIN e ON e.run_id = tg.run_id AND e.cause = root UNION SELECT r.run_id, target, effect FROM r JOIN e ON e.run_id = r.run_id AND e.cause = r.event_id) SELECT * FROM r")
def descendants(spark, sf):
    edges, ends = _daily(spark, sf)
    return el.reachable(edges, ends.select("run_id", F.col("root").alias("event_id")), forward=True)


OPS = WHOLE + """, d AS (SELECT run_id, event_index, 'u:' || user_id AS entity_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, 'User' AS type_id,
  CASE WHEN k % 4 = 0 THEN 'stale' END AS before, event_type AS after FROM whole), init AS (SELECT DISTINCT run_id, entity_id, 'User' AS type_id, 'start' AS attributes FROM d WHERE substr(entity_id, 3)::BIGINT % 3 = 0),
 al AS (SELECT run_id, entity_id, -1 AS event_index, 'create' AS op, NULL AS before, attributes AS after FROM init UNION ALL SELECT run_id, entity_id, event_index, op, before, after FROM d)"""


def _ops(spark, sf):
    lg = whole_log(spark, sf)
    d = lg.select("run_id", "event_index", F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("entity_id"),
                  F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.lit("User").alias("type_id"),
                  F.when(F.col("k") % 4 == 0, "stale").alias("before"), F.col("event_type").alias("after"))
    init = d.filter(F.substring("entity_id", 3, 20).cast("long") % 3 == 0).select("run_id", "entity_id", "type_id", F.lit("start").alias("attributes")).distinct()
    return init, d


@query("eventlog_state_as_of", f"WITH {OPS} SELECT run_id, entity_id, 'User' AS type_id, attributes FROM (SELECT run_id, entity_id, max_by(op, event_index) AS op, max_by(after, event_index) AS attributes FROM al GROUP BY ALL) WHERE op <> 'delete'")
def state(spark, sf):
    return el.state_as_of(*_ops(spark, sf), None)


@query("eventlog_replay_violations", f"""WITH {OPS}, p AS (SELECT *, lag(op) OVER w AS pop, lag(after) OVER w AS pafter FROM al WINDOW w AS (PARTITION BY run_id, entity_id ORDER BY event_index)), c AS (SELECT run_id, entity_id, event_index,
  CASE WHEN op = 'create' AND coalesce(pop <> 'delete', false) THEN 'create_of_present' WHEN op = 'delete' AND NOT coalesce(pop <> 'delete', false) THEN 'delete_of_absent' WHEN op = 'update' AND NOT coalesce(pop <> 'delete', false) THEN 'update_of_absent'
   WHEN op <> 'create' AND before IS NOT NULL AND before IS DISTINCT FROM pafter THEN 'stale_before' END AS code FROM p WHERE event_index >= 0) SELECT * FROM c WHERE code IS NOT NULL""")
def replay(spark, sf):
    return el.replay_violations(*_ops(spark, sf))


@query("eventlog_final_state_violations", f"WITH {WHOLE}, l AS (SELECT user_id, max_by(event_type, event_index) AS last_value FROM whole GROUP BY user_id) SELECT 'all' AS run_id, user_id, last_value, 'view' AS reported FROM l WHERE user_id % 5 = 0 AND last_value <> 'view'")
def final_state(spark, sf):
    lg = whole_log(spark, sf)
    rep = lg.groupBy("run_id", "user_id").agg(F.max_by("event_type", "event_index").alias("event_type"))
    rep = rep.withColumn("event_type", F.when(F.col("user_id") % 5 == 0, "view").otherwise(F.col("event_type")))
    return el.final_state_violations(lg, "user_id", "event_type", rep)


LIK = """lik AS (SELECT run_id, coalesce(sum(ln(hazard)) FILTER (kind = 'internal'), 0) AS lh, sum(survival_integral) + 0.25 * (2678400 - max(t)) / 86400 AS ia, count(*) FILTER (kind = 'internal') AS ni,
  count(*) FILTER (kind <> 'internal') AS nc, bool_or(event_id % 997 = 0) AS bad FROM log GROUP BY run_id)"""


@query("eventlog_path_likelihood", f"""WITH {LOG}, {LIK} SELECT run_id, CASE WHEN NOT bad THEN {q6('lh - ia', 5)} END AS log_likelihood, ni AS internal_events, nc AS conditioned_events, CASE WHEN bad THEN 'invalid_survival_integral' END AS problem FROM lik""")
def likelihood(spark, sf):
    lg = log(spark, sf)
    lg = lg.withColumn("survival_integral", F.when(F.col("event_id") % 997 == 0, F.lit(-1.0)).otherwise(F.col("survival_integral")))
    term = lg.select("run_id").distinct().withColumns({"terminal_time": F.lit(2678400.0), "terminal_activity": F.lit(0.25 / 86400)})
    got = el.path_likelihood(lg, term)
    return got.select("run_id", r6("log_likelihood", 5).alias("log_likelihood"), "internal_events", "conditioned_events", "problem")


@query("eventlog_kind_summary", f"WITH {LOG} SELECT run_id, kind, count(*) AS events, {q6('max(t)')} AS last_t FROM log GROUP BY ALL")
def kinds(spark, sf):
    return el.kind_summary(log(spark, sf)).withColumn("last_t", r6("last_t"))


@query("eventlog_observable_series", f"WITH {LOG} SELECT run_id, event_index, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY event_index)::BIGINT AS value FROM log")
def series(spark, sf):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return el.observable_series(log(spark, sf), step).select("run_id", "event_index", F.col("value").cast("long").alias("value"))


@query("eventlog_max_concurrency", """WITH m AS (SELECT l_suppkey AS run_id, epoch(o_orderdate) AS t, 1 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT l_suppkey, epoch(l_shipdate), -1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 n AS (SELECT run_id, t, sum(d) AS d FROM m GROUP BY ALL) SELECT run_id, max(lv)::BIGINT AS max_concurrency FROM (SELECT run_id, sum(d) OVER (PARTITION BY run_id ORDER BY t) AS lv FROM n) GROUP BY run_id""")
def concurrency(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return el.max_concurrency(li.select(F.col("l_suppkey").alias("run_id"), sec("o_orderdate").alias("s"), sec("l_shipdate").alias("e")), "s", "e")


@query("eventlog_first_passage", f"WITH {LOG} SELECT run_id, {q6('CASE WHEN run_id % 10 = 0 THEN 0 ELSE min(t) FILTER (value > 150) END')} AS first_passage FROM log GROUP BY run_id")
def passage(spark, sf):
    return el.first_passage(log(spark, sf), F.col("value") > 150, initial=F.col("run_id") % 10 == 0).withColumn("first_passage", r6("first_passage"))


@query("eventlog_explosion_check", f"WITH {LOG} SELECT run_id, event_index FROM (SELECT *, count(*) OVER (PARTITION BY run_id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS c FROM log) WHERE c > 2")
def explosion(spark, sf):
    return el.explosion_check(log(spark, sf), 7200.0, 2).select("run_id", "event_index")


@query("eventlog_transitions_only", f"WITH {LOG} SELECT run_id, event_index, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY run_id ORDER BY event_index) AS p FROM log) WHERE p IS NULL OR p <> event_type")
def transitions(spark, sf):
    return el.transitions_only(log(spark, sf), "event_type", ["run_id"], ["event_index"]).select("run_id", "event_index", "event_type")


META = BASE + """, meta AS (SELECT k % 10 AS run_id, 'r' || k || ':' || (user_id % 20) AS rule_id, 'T' || (k % 7) AS template_id, t, event_id AS sequence, CASE event_type WHEN 'signup' THEN 'INSTANTIATE' WHEN 'view' THEN 'DISABLE' WHEN 'error' THEN 'REMOVE' ELSE 'ENABLE' END AS action FROM base)"""


def _meta(spark, sf):
    action = F.when(F.col("event_type") == "signup", "INSTANTIATE").when(F.col("event_type") == "view", "DISABLE").when(F.col("event_type") == "error", "REMOVE").otherwise("ENABLE")
    return base(spark, sf).select((F.col("k") % 10).alias("run_id"), F.concat(F.lit("r"), "k", F.lit(":"), F.col("user_id") % 20).alias("rule_id"), F.concat(F.lit("T"), F.col("k") % 7).alias("template_id"),
                                  "t", F.col("event_id").alias("sequence"), action.alias("action"))


@query("eventlog_active_rules_as_of", f"""WITH {META}, l AS (SELECT run_id, rule_id, max_by(action, (t, sequence)) AS action, max_by(template_id, (t, sequence)) FILTER (action = 'INSTANTIATE') AS template_id FROM meta WHERE t <= 1900800 GROUP BY ALL)
SELECT run_id, rule_id, template_id, action <> 'DISABLE' AS enabled FROM l WHERE action <> 'REMOVE'""")
def active_rules(spark, sf):
    return el.active_rules_as_of(_meta(spark, sf), 1900800.0)


@query("eventlog_instance_limit", f"""WITH {META} SELECT run_id, template_id, sequence, live::BIGINT AS live FROM (SELECT *, sum(CASE action WHEN 'INSTANTIATE' THEN 1 WHEN 'REMOVE' THEN -1 ELSE 0 END) OVER (PARTITION BY run_id, template_id ORDER BY t, sequence) AS live FROM meta) WHERE live > CASE template_id WHEN 'T0' THEN 1 ELSE 3 END""")
def instance_limit(spark, sf):
    got = el.instance_limit(_meta(spark, sf), {f"T{i}": 1 if i == 0 else 3 for i in range(7)})
    return got.select("run_id", "template_id", "sequence", F.col("live").cast("long").alias("live"))


U = "('0x' || substr(md5(concat_ws('|', {seed}, {key})), 1, 8))::BIGINT / 4294967296.0"


@query("choice_weighted_select", f"""WITH it AS (SELECT s_nationkey AS nk, s_suppkey, greatest(floor(s_acctbal / 100), 0) AS w FROM supplier), c AS (SELECT nk, s_suppkey, sum(w) OVER (PARTITION BY nk ORDER BY s_suppkey) AS c, sum(w) OVER (PARTITION BY nk) AS tot FROM it WHERE w > 0),
 d AS (SELECT c_nationkey AS nk, c_custkey AS draw, {U.format(seed=11, key='c_custkey')} AS u FROM customer) SELECT nk, draw::VARCHAR AS draw, min(s_suppkey) AS s_suppkey FROM d JOIN c USING (nk) WHERE c > u * tot GROUP BY ALL""")
def weighted(spark, sf):
    items = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nk"), "s_suppkey", F.greatest(F.floor(F.col("s_acctbal") / 100), F.lit(0)).alias("w"))
    draws = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nk"), F.col("c_custkey").alias("draw"), (hashed(F.lit(11), F.col("c_custkey")) / 4294967296.0).alias("u"))
    return el.weighted_select(items, draws, ["nk"], "s_suppkey", "w").drop("u")


@query("choice_two_level_select", f"""WITH r AS (SELECT p_brand AS rule_id, sum(p_size)::DOUBLE AS a FROM part GROUP BY 1), rc AS (SELECT *, sum(a) OVER (ORDER BY rule_id) AS c, sum(a) OVER () AS tot FROM r),
 d AS (SELECT o_orderkey AS draw, {U.format(seed=1, key='o_orderkey')} AS u1, {U.format(seed=2, key='o_orderkey')} AS u2 FROM orders), pick AS (SELECT draw, u2, min(rule_id) AS rule_id FROM d JOIN rc ON c > u1 * tot GROUP BY ALL),
 mc AS (SELECT p_brand AS rule_id, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS c, sum(p_size) OVER (PARTITION BY p_brand) AS tot FROM part)
SELECT draw::VARCHAR AS draw, rule_id, min(p_partkey) AS match_id FROM pick JOIN mc USING (rule_id) WHERE c > u2 * tot GROUP BY ALL""")
def two_level(spark, sf):
    occ = table(spark, sf, "part").select(F.lit(1).alias("g"), F.col("p_brand").alias("rule_id"), F.col("p_partkey").alias("match_id"), F.col("p_size").alias("hazard"))
    u = lambda s: hashed(F.lit(s), F.col("o_orderkey")) / 4294967296.0
    draws = table(spark, sf, "orders").select(F.lit(1).alias("g"), F.col("o_orderkey").cast("string").alias("draw"), u(1).alias("u"), u(2).alias("u2"))
    rules = el.weighted_select(occ.groupBy("g", "rule_id").agg(F.sum("hazard").alias("hazard")), draws.drop("u2"), ["g"], "rule_id", "hazard")
    second = rules.select("draw", "rule_id").join(draws.select("draw", F.col("u2").alias("u")), "draw")
    return el.weighted_select(occ.drop("g"), second, ["rule_id"], "match_id", "hazard").drop("u")


HAZ = "occ AS (SELECT l_returnflag AS rule_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * l_discount AS h FROM lineitem)"


@query("choice_selection_probability", f"""WITH {HAZ} SELECT rule_id, l_suppkey, {q6('sum(h / tr)', 9)} AS p_in_rule, {q6('sum(h / tt)', 9)} AS p_overall FROM (SELECT *, sum(h) OVER (PARTITION BY rule_id) AS tr, sum(h) OVER () AS tt FROM occ) GROUP BY ALL""")
def probability(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("rule_id"), "l_suppkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("hazard"))
    got = el.selection_probability(li).groupBy("rule_id", "l_suppkey").agg(F.sum("p_in_rule").alias("p_in_rule"), F.sum("p_overall").alias("p_overall"))
    return got.withColumns({c: r6(c, 9) for c in ("p_in_rule", "p_overall")})


@query("choice_rule_activity", f"WITH {HAZ} SELECT rule_id, {q6('sum(h)', 2)} AS activity, count(*) AS occurrences FROM occ GROUP BY ROLLUP (rule_id)")
def activity(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("rule_id"), (F.col("l_extendedprice") * F.col("l_discount")).alias("hazard"))
    return el.activity(li).withColumn("activity", r6("activity", 2))


STOCK = BASE + """, ev AS (SELECT user_id AS sku, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, event_id, CASE event_type WHEN 'signup' THEN 'receive' WHEN 'purchase' THEN 'reserve' ELSE 'release' END AS kind,
  1 + floor(value)::BIGINT % 5 AS q FROM base WHERE event_type IN ('signup', 'purchase', 'error')),
 st(sku, n, event_id, a, r, status) AS (SELECT DISTINCT sku, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM ev UNION ALL SELECT ev.sku, ev.n, ev.event_id,
   CASE WHEN kind = 'receive' THEN a + q WHEN kind = 'reserve' AND q <= a THEN a - q WHEN kind = 'release' AND q <= r THEN a + q ELSE a END,
   CASE WHEN kind = 'reserve' AND q <= a THEN r + q WHEN kind = 'release' AND q <= r THEN r - q ELSE r END,
   CASE WHEN kind = 'receive' OR (kind = 'reserve' AND q <= a) OR (kind = 'release' AND q <= r) THEN 'applied' ELSE 'rejected' END FROM st JOIN ev ON ev.sku = st.sku AND ev.n = st.n + 1)"""


def stock_events(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "receive").when(F.col("event_type") == "purchase", "reserve").when(F.col("event_type") == "error", "release")
    return base(spark, sf).select(F.col("user_id").alias("sku"), "t", "event_id", kind.alias("kind"), (1 + F.floor("value") % 5).alias("quantity")).filter("kind IS NOT NULL")


@query("inventory_ledger", f"WITH RECURSIVE {STOCK} SELECT sku, event_id, status, a + r AS on_hand, r AS reserved FROM st WHERE n > 0")
def ledger(spark, sf):
    return inv.ledger(stock_events(spark, sf), ["sku"], ["t", "event_id"]).select("sku", "event_id", "status", "on_hand", "reserved")


@query("inventory_availability", f"""WITH RECURSIVE {STOCK}, l AS (SELECT sku, max_by(a, n) AS a, max_by(r, n) AS r FROM st GROUP BY sku), want AS (SELECT DISTINCT user_id AS sku FROM base UNION SELECT c_custkey FROM customer)
SELECT sku, coalesce(a + r, 0) AS on_hand, coalesce(r, 0) AS reserved, coalesce(a, 0) AS available FROM want LEFT JOIN l USING (sku)""")
def availability(spark, sf):
    want = base(spark, sf).select(F.col("user_id").alias("sku")).union(table(spark, sf, "customer").select("c_custkey"))
    return inv.availability(want, inv.ledger(stock_events(spark, sf), ["sku"], ["t", "event_id"]), ["sku"], ["t", "event_id"])


@query("inventory_strict_decode", """SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'bad_quantity' WHEN 1 THEN 'bad_quantity' WHEN 2 THEN 'bad_quantity' WHEN 3 THEN 'bad_text' WHEN 4 THEN 'unknown_kind' WHEN 5 THEN 'wrong_fields' WHEN 6 THEN 'not_an_object' END AS problem,
 CASE WHEN event_id % 8 = 7 THEN 1 + user_id % 5 END AS quantity, CASE WHEN event_id % 8 = 7 THEN user_id::VARCHAR END AS sku FROM events""")
def decode(spark, sf):
    e = table(spark, sf, "events")
    head = F.concat(F.lit('{"event_id":"'), "event_id", F.lit('","sku":"'))
    body = lambda tail: F.concat(head, "user_id", F.lit('","kind":'), *tail)
    m = F.col("event_id") % 8
    raw = (
        F.when(m == 0, body([F.lit('"receive","quantity":0}')])).when(m == 1, body([F.lit('"receive","quantity":true}')])).when(m == 2, body([F.lit('"receive","quantity":"2"}')]))
        .when(m == 3, F.concat(head, F.lit('","kind":"receive","quantity":2}'))).when(m == 4, body([F.lit('"return","quantity":2}')])).when(m == 5, body([F.lit('"receive","quantity":2,"x":1}')]))
        .when(m == 6, F.concat(F.lit("["), "event_id", F.lit("]"))).otherwise(body([F.lit('"reserve","quantity":'), 1 + F.col("user_id") % 5, F.lit("}")]))
    )
    return inv.decode_event(e.select(F.col("event_id").alias("id"), raw.alias("raw"))).select("id", "problem", "quantity", "sku")
