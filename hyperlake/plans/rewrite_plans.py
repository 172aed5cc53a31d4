"""Registered queries: rule occurrences, rates, deltas, batches, boundary effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import match as mt
from ..operators import rewrite as rw
from ..operators.match import NAC, E, Pattern, V
from ..operators.rewrite import NE, NV, Ex, Rule
from .data import q6, r6, table
from .match_plans import LINES
from .registry import query
from .tpch_graph import graph, vid

LEFT = Pattern([V("o", "Order"), V("p", "Part"), V("s", "Supplier")], [E("l", "Supply", {"order": ["o"]}, {"part": ["p"], "supplier": ["s"]}, {"flag": "R"})])
# a returned line goes away, its order total drops by the line's price
CANCEL = Rule("cancel-line", LEFT, [NV("o", "Order", {"total": Ex("o__total - l__price")}), NV("p", "Part"), NV("s", "Supplier")], hazard="l__price * l__discount * p_gain", guard="l__qty > 5", parameters={"gain": 0.5},
              outputs=[rw.Output("ledger", "refund", {"amount": Ex("l__price"), "order": Ex("v_o")})])
# an order line is replaced by a direct link of part and supplier
DROP_ORDER = Rule("drop-order", Pattern([V("o", "Order"), V("c", "Customer")], [E("pl", "Placed", {"customer": ["c"]}, {"order": ["o"]})]), [NV("c", "Customer")])
OCC = f"{LINES}, occ AS (SELECT e AS e_l, o AS v_o, p AS v_p, s AS v_s, l_extendedprice * l_discount * 0.5 AS hazard, l_extendedprice, o_totalprice, o_orderstatus, o_orderpriority FROM ln JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 5)"


@query("rewrite_occurrences", f"WITH {OCC} SELECT e_l, v_o, v_p, v_s, {q6('hazard')} AS hazard FROM occ")
def occurrences(spark, sf):
    return rw.occurrences(graph(spark, sf), CANCEL).select("e_l", "v_o", "v_p", "v_s", r6("hazard").alias("hazard"))


@query("rewrite_dangling_check", "SELECT 'O:' || o_orderkey AS v_o, 'C:' || o_custkey AS v_c FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dangling(spark, sf):
    return rw.occurrences(graph(spark, sf), DROP_ORDER).select("v_o", "v_c")


@query("rewrite_boundary_gluing", "SELECT 'O:' || o_orderkey AS v_o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 5 <> 0")
def gluing(spark, sf):
    h = table(spark, sf, "orders").select(vid("H", "o_orderkey").alias("handle_id"), F.when(F.col("o_orderkey") % 5 == 0, vid("O", "o_orderkey")).alias("binding"))
    return rw.occurrences(graph(spark, sf), DROP_ORDER, handles=h).select("v_o")


@query("rewrite_delta", f"""WITH {OCC} SELECT 'edge' AS entity_kind, 'delete' AS op, e_l AS entity_id, 'Supply' AS type_id, NULL::DOUBLE AS total_after FROM occ
 UNION ALL SELECT 'vertex', 'update', v_o, 'Order', {q6('o_totalprice - l_extendedprice', 4)} FROM occ WHERE l_extendedprice <> 0""")
def delta(spark, sf):
    g = graph(spark, sf)
    d = rw.delta(g, CANCEL, rw.occurrences(g, CANCEL, keep_attrs=["o", "l"]))
    return d.select("entity_kind", "op", "entity_id", "type_id", r6(F.get_json_object("after", "$.total").cast("double"), 4).alias("total_after"))


RETURN = Rule("mark-return", Pattern([V("c", "Customer"), V("o", "Order")], [E("pl", "Placed", {"customer": ["c"]}, {"order": ["o"]})]), [NV("c", "Customer", {"segment": "RETURNS"}), NV("o", "Order"), NV("n", "Nation", {"name": "NEW"})],
              [NE("pl", "Placed", {"customer": ["c"]}, {"order": ["o"]}), NE("li", "LocatedIn", {"party": ["c"]}, {"nation": ["n"]})], guard="o__status = 'P'")


@query("rewrite_delta_creates", """WITH m AS (SELECT o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
SELECT entity_kind, op, type_id, count(*) AS n FROM (SELECT 'vertex' AS entity_kind, 'update' AS op, 'Customer' AS type_id FROM m WHERE c_mktsegment <> 'RETURNS' UNION ALL SELECT 'vertex', 'create', 'Nation' FROM m UNION ALL SELECT 'edge', 'create', 'LocatedIn' FROM m) GROUP BY ALL""")
def creates(spark, sf):
    g = graph(spark, sf)
    d = rw.delta(g, RETURN, rw.occurrences(g, RETURN, keep_attrs=["c", "o"]))
    return d.groupBy("entity_kind", "op", "type_id").agg(F.count(F.lit(1)).alias("n"))


@query("rewrite_apply_delta", f"WITH {OCC}, t AS (SELECT v_o, max(o_totalprice - l_extendedprice) AS a FROM occ GROUP BY v_o) SELECT 'O:' || o_orderkey AS vertex_id, o_orderstatus AS status, a IS NOT NULL AS changed, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM occ) AS lines_left FROM orders LEFT JOIN t ON v_o = 'O:' || o_orderkey")
def apply_delta(spark, sf):
    g = graph(spark, sf)
    d = rw.delta(g, CANCEL, rw.occurrences(g, CANCEL, keep_attrs=["o", "l"]))
    g2 = rw.apply_delta(g, d, ["Order"], ["Supply"])
    old = g.vertex_tables["Order"].select("vertex_id", F.col("total").alias("was"))
    left = g2.edge_tables["Supply"].agg(F.count(F.lit(1)).alias("lines_left"), F.lit(1).alias("k"))
    both = g2.vertex_tables["Order"].join(old, "vertex_id").withColumn("k", F.lit(1)).join(left, "k")
    return both.select("vertex_id", "status", (F.col("total") != F.col("was")).alias("changed"), "lines_left")


@query("rewrite_touched_entities", f"WITH {OCC} SELECT DISTINCT e_l AS entity_id FROM occ UNION SELECT v_o FROM occ")
def touched(spark, sf):
    g = graph(spark, sf)
    return rw.touched_entities(rw.delta(g, CANCEL, rw.occurrences(g, CANCEL, keep_attrs=["o", "l"])))


@query("rewrite_neighbourhood", f"WITH {OCC} SELECT DISTINCT e_l AS entity_id FROM occ UNION SELECT v_o FROM occ UNION SELECT v_p FROM occ UNION SELECT v_s FROM occ")
def neighbourhood(spark, sf):
    g = graph(spark, sf)
    return rw.neighbourhood(g, rw.delta(g, CANCEL, rw.occurrences(g, CANCEL, keep_attrs=["o", "l"])))


PAIRS = """tc AS (SELECT match_id, 'O:' || o AS ent, true AS w FROM m UNION ALL SELECT match_id, 'P:' || p, false FROM m),
 b AS (SELECT ent, min(match_id) AS mn FROM tc GROUP BY ent HAVING bool_or(w))"""


@query("rewrite_conflict_free_round", f"""WITH m AS (SELECT DISTINCT o_orderkey AS o, l_partkey AS p, lpad(l_partkey::VARCHAR, 12, '0') || ':' || lpad(o_orderkey::VARCHAR, 12, '0') AS match_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 {PAIRS} SELECT match_id FROM m WHERE NOT EXISTS (SELECT 1 FROM tc JOIN b USING (ent) WHERE tc.match_id = m.match_id AND mn <> m.match_id)""")
def conflict_round(spark, sf):
    return rw.first_winners(_touch(spark, sf))


def _touch(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    items = F.array(F.struct(vid("O", "l_orderkey").alias("entity_id"), F.lit(True).alias("is_write")), F.struct(vid("P", "l_partkey").alias("entity_id"), F.lit(False).alias("is_write")))
    return li.select(F.concat_ws(":", pad("l_partkey"), pad("l_orderkey")).alias("match_id"), F.inline(items))


@query("rewrite_conflict_free_fixpoint", "SELECT lpad(min(l_partkey)::VARCHAR, 12, '0') || ':' || lpad(l_orderkey::VARCHAR, 12, '0') AS match_id FROM lineitem GROUP BY l_orderkey")
def conflict_fixpoint(spark, sf):
    return rw.conflict_free_batch(_touch(spark, sf))


@query("rewrite_apply_batch", """WITH m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT (SELECT count(*) FROM m) AS customers_marked, (SELECT count(*) FROM m) AS nations_made,
 (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM m) AS located""")
def batch(spark, sf):
    g2, _ = rw.apply_batch(graph(spark, sf), RETURN)
    k = F.lit(1).alias("k")
    a = g2.vertex_tables["Customer"].filter("segment = 'RETURNS'").agg(F.count(F.lit(1)).alias("customers_marked"), k)
    b = g2.vertex_tables["Nation"].filter("name = 'NEW'").agg(F.count(F.lit(1)).alias("nations_made"), k)
    c = g2.edge_tables["LocatedIn"].agg(F.count(F.lit(1)).alias("located"), k)
    return a.join(b, "k").join(c, "k").drop("k")


# an open order is closed unless its customer ever returned a part of size 7: two steps from the customer
SIZED_RETURN = Pattern([V("c", "Customer"), V("o2", "Order"), V("p", "Part", {"size": 7}), V("s", "Supplier")],
                       [E("p2", "Placed", {"customer": ["c"]}, {"order": ["o2"]}), E("r", "Supply", {"order": ["o2"]}, {"part": ["p"], "supplier": ["s"]}, {"flag": "R"})])
CLOSE = Rule("close-order", Pattern([V("c", "Customer"), V("o", "Order")], [E("pl", "Placed", {"customer": ["c"]}, {"order": ["o"]})]), [NV("c", "Customer"), NV("o", "Order", {"status": "closed"})],
             [NE("pl", "Placed", {"customer": ["c"]}, {"order": ["o"]})], guard="o__status == 'P'", conditions=[NAC(SIZED_RETURN, {"c": "c"})])


@query("rewrite_conditional_batch", """SELECT o_orderstatus AS before, CASE WHEN o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_size = 7)
 THEN 'closed' ELSE o_orderstatus END AS after, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL""")
def conditional_batch(spark, sf):
    g = graph(spark, sf)
    after, _ = rw.apply_batch(g, CLOSE)
    both = g.vertex_tables["Order"].select("vertex_id", F.col("status").alias("before")).join(after.vertex_tables["Order"].select("vertex_id", F.col("status").alias("after"), "priority"), "vertex_id")
    return both.groupBy("before", "after", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("rewrite_hazard_validity", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'invalid_hazard' AS hazard_problem FROM lineitem WHERE l_discount = 0 OR l_discount - 0.02 < 0")
def hazard(spark, sf):
    li = table(spark, sf, "lineitem")
    got = rw.hazard_of(li, "case when l_discount = 0 then null else l_discount - 0.02 end", "error")
    return got.filter("hazard_problem IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "hazard_problem")


@query("rewrite_hazard_bound_violations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40")
def bound(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"hazard": F.col("l_quantity"), "hazard_bound": F.lit(40.0)})
    return rw.bound_violations(li).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("rewrite_integrated_hazard", f"WITH {OCC} SELECT e_l, {q6('hazard * 3.5')} AS integral FROM occ")
def integral(spark, sf):
    return rw.integrated_hazard(rw.occurrences(graph(spark, sf), CANCEL), CANCEL, 1.0, 4.5).select("e_l", r6("integral").alias("integral"))


TIMED = Rule("timed", LEFT, CANCEL.vertices, hazard="l__qty * (1 + time)", bound="l__qty * 100", integral="l__qty * ((horizon - time) + (horizon * horizon - time * time) / 2)")


@query("rewrite_integrated_activity", "SELECT round(sum(l_quantity * (2 + (9 - 1) / 2.0)), 3) + 0.0 AS integral, count(*) AS occurrences FROM lineitem WHERE l_returnflag = 'R'")
def activity(spark, sf):
    occ = rw.occurrences(graph(spark, sf), TIMED, time=1.0)
    return rw.integrated_activity(rw.integrated_hazard(occ, TIMED, 1.0, 3.0)).withColumn("integral", r6("integral", 3))


TIERED = Rule("tiered", LEFT, CANCEL.vertices, hazard="l__qty * (2 if o__status == 'F' else 1) if l__qty >= 10 else l__qty // 2", guard="l__discount <> 0 and l__qty != 7", bound="l__qty * 2")


@query("rewrite_tiered_hazard", """SELECT 'O:' || l_orderkey AS v_o, count(*) AS n, sum(CASE WHEN l_quantity >= 10 THEN l_quantity * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END ELSE floor(l_quantity / 2) END)::DOUBLE AS activity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_discount <> 0 AND l_quantity <> 7 GROUP BY l_orderkey""")
def tiered(spark, sf):
    occ = rw.occurrences(graph(spark, sf), TIERED)
    return occ.groupBy("v_o").agg(F.count(F.lit(1)).alias("n"), F.sum("hazard").alias("activity"))


@query("rewrite_outputs", f"WITH {OCC} SELECT 'ledger' AS handle_id, 'refund' AS event_type, v_o AS order_id, {q6('l_extendedprice', 2)} AS amount FROM occ")
def outputs(spark, sf):
    got = rw.outputs(rw.occurrences(graph(spark, sf), CANCEL), CANCEL, {"ledger": "output"})
    return got.select("handle_id", "event_type", F.get_json_object("payload", "$.order").alias("order_id"), r6(F.get_json_object("payload", "$.amount").cast("double"), 2).alias("amount"))


@query("rewrite_boundary_effects", """SELECT 'H:' || c_custkey AS handle_id, kind, CASE WHEN c_custkey % 3 = 0 THEN 'C:' || c_custkey END AS before,
 CASE WHEN kind IN ('bind', 'rebind') THEN 'N:' || c_nationkey END AS after, kind = 'delete_handle' AS deleted,
 CASE WHEN kind = 'unbind' AND c_custkey % 2 = 0 THEN 'not_nullable' WHEN kind = 'bind' AND c_custkey % 3 = 0 THEN 'already_bound' END AS problem
 FROM (SELECT *, (['bind', 'rebind', 'unbind', 'delete_handle'])[c_custkey % 4 + 1] AS kind FROM customer)""")
def effects(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    handles = c.select(vid("H", "c_custkey").alias("handle_id"), F.when(k % 3 == 0, vid("C", "c_custkey")).alias("binding"), (k % 2 != 0).alias("nullable"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("bind", "rebind", "unbind", "delete_handle")]), (k % 4 + 1).cast("int"))
    return rw.boundary_effects(handles, c.select(vid("H", "c_custkey").alias("handle_id"), kind.alias("kind"), vid("N", "c_nationkey").alias("vertex_id")))


@query("rewrite_rule_instances", """SELECT p_brand AS instance_id, count(*) AS matches FROM lineitem, (SELECT p_brand, min(p_size)::DOUBLE AS gain, any_value('A') AS flag FROM part GROUP BY 1) WHERE l_returnflag = 'R' AND gain <= 2 GROUP BY 1""")
def instances(spark, sf):
    g = graph(spark, sf)
    m = mt.matches(g, LEFT, rule_id="t")
    b = table(spark, sf, "part").groupBy(F.col("p_brand").alias("instance_id")).agg(F.min("p_size").cast("double").alias("gain"))
    got, _ = rw.rule_instances(m.select("match_id"), b, {"gain": {"lower": 0.0, "upper": 2.0}})
    return got.groupBy("instance_id").agg(F.count(F.lit(1)).alias("matches"))


@query("rewrite_rule_instances_rejected", "SELECT p_brand AS instance_id, 'gain is above its upper bound' AS problem FROM (SELECT p_brand, max(p_size) AS gain FROM part GROUP BY 1) WHERE gain > 49")
def rejected(spark, sf):
    b = table(spark, sf, "part").groupBy(F.col("p_brand").alias("instance_id")).agg(F.max("p_size").cast("double").alias("gain"))
    return rw.rule_instances(table(spark, sf, "region"), b, {"gain": {"lower": 0.0, "upper": 49.0}})[1]


W = {"route_rate": 0.5, "choice_beta": 0.3, "speed_weight": 1.0, "service_scale": 50.0, "link_weight": 0.5, "load_weight": 0.4, "energy_weight": 0.2, "qos_reliability_weight": 0.7, "qos_fidelity_weight": 0.6, "semantic_weight": 0.8}
BASEU = "1.0 * l_quantity / 50.0 + 0.5 * l_discount - 0.4 * (l_linenumber / 7.0) - 0.2 * l_tax"


@query("rewrite_routing_scores", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {q6(f'0.5 * exp(0.3 * ({BASEU}))')} AS throughput_score, {q6(f'0.5 * exp(0.3 * ({BASEU} + 0.7 * 0.9 + 0.6 * l_tax))')} AS qos_score,
 {q6(f'0.5 * exp(0.3 * ({BASEU} + 0.7 * 0.9 + 0.6 * l_tax + 0.8 * (l_discount / 2.0) * 0.9 * l_tax))')} AS semantic_score FROM lineitem""")
def routing(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({
        "service_rate": F.col("l_quantity"), "link_quality": F.col("l_discount"), "load": F.col("l_linenumber"), "capacity": F.lit(7.0), "energy_cost": F.col("l_tax"),
        "reliability": F.lit(0.9), "fidelity": F.col("l_tax"), "utility": F.col("l_discount"), "deadline": F.lit(2.0)})
    got = rw.routing_scores(li, W)
    return got.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[r6(f"{p}_score").alias(f"{p}_score") for p in ("throughput", "qos", "semantic")])


@query("rewrite_payload_violations", """SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN 'below_minimum' WHEN 1 THEN 'wrong_kind' WHEN 2 THEN 'missing_required' ELSE 'unknown_field' END AS code, CASE WHEN user_id % 5 = 3 THEN 'x' ELSE 'load' END AS detail FROM events WHERE user_id % 5 < 4""")
def payload(spark, sf):
    m = F.col("user_id") % 5
    body = F.when(m == 0, '{"load": -1}').when(m == 1, '{"load": "3"}').when(m == 2, "{}").when(m == 3, '{"load": 3, "x": 1}').otherwise('{"load": 3}')
    raw = table(spark, sf, "events").select(F.col("event_id").alias("id"), body.alias("payload"))
    return rw.payload_violations(raw, {"load": gr.Attr("int", required=True, minimum=0)})


@query("rewrite_occurrence_limits", f"WITH {OCC} SELECT 'cancel-line' AS rule_id, count(*) AS matches, round(sum(hazard), 2) + 0.0 AS activity, true AS exceeded FROM occ")
def occurrence_limits(spark, sf):
    occ = rw.occurrences(graph(spark, sf), CANCEL)
    return rw.occurrence_limits(occ, max_matches=100).withColumn("activity", r6("activity", 2))


@query("rewrite_all_occurrences_ranked", f"WITH {OCC} SELECT 'cancel-line' AS rule_id, count(*) AS n, {q6('sum(hazard)', 2)} AS hazard FROM occ UNION ALL SELECT 'timed', count(*), {q6('sum(l_quantity * 2.0)', 2)} FROM lineitem WHERE l_returnflag = 'R'")
def all_occurrences(spark, sf):
    g = graph(spark, sf)
    both = rw.canonical_order(rw.all_occurrences([rw.occurrences(g, CANCEL), rw.occurrences(g, TIMED, time=1.0)]))
    return both.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("hazard"), 2).alias("hazard"))
