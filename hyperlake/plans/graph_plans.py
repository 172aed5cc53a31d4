"""Registered queries: graph tables, validation, attribute rules, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..sources import runs as rs
from .data import q6, r6, table
from .registry import query
from .tpch_graph import CATALOG, LINE_ID, TRADE, graph, line_id, trade_ends, vid

VERTS = """verts AS (SELECT 'C:' || c_custkey AS id, 'Customer' AS t FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'P:' || p_partkey, 'Part' FROM part
 UNION ALL SELECT 'O:' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'N:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'Region' FROM region)"""
INC = f"""inc AS (SELECT {LINE_ID} AS e, 'Supply' AS t, unnest([{{'side': 'tail', 'role': 'order', 'v': 'O:' || l_orderkey}}, {{'side': 'head', 'role': 'part', 'v': 'P:' || l_partkey}},
   {{'side': 'head', 'role': 'supplier', 'v': 'S:' || l_suppkey}}], recursive := true) FROM lineitem
 UNION ALL SELECT 'PL:' || o_orderkey, 'Placed', unnest([{{'side': 'tail', 'role': 'customer', 'v': 'C:' || o_custkey}}, {{'side': 'head', 'role': 'order', 'v': 'O:' || o_orderkey}}], recursive := true) FROM orders
 UNION ALL SELECT 'LI:' || p, 'LocatedIn', unnest([{{'side': 'tail', 'role': 'party', 'v': p}}, {{'side': 'head', 'role': 'nation', 'v': 'N:' || n}}], recursive := true)
   FROM (SELECT 'C:' || c_custkey AS p, c_nationkey AS n FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_nationkey FROM supplier)
 UNION ALL SELECT 'W:' || n_nationkey, 'Within', unnest([{{'side': 'tail', 'role': 'nation', 'v': 'N:' || n_nationkey}}, {{'side': 'head', 'role': 'region', 'v': 'R:' || n_regionkey}}], recursive := true) FROM nation)"""


@query("graph_incidences", f"WITH {INC} SELECT t AS edge_type, side, role, count(*) AS n, count(DISTINCT e) AS edges, count(DISTINCT v) AS vertices FROM inc GROUP BY ALL")
def incidences(spark, sf):
    return graph(spark, sf).slot_counts()


@query("graph_tables_round_trip", """SELECT 'O:' || l_orderkey AS tail_order, 'P:' || l_partkey AS head_part, 'S:' || l_suppkey AS head_supplier, count(*) AS n FROM lineitem GROUP BY ALL""")
def round_trip(spark, sf):
    g = graph(spark, sf)
    plain = {"Supply": g.edge_tables["Supply"].select("edge_id", "qty")}
    back = gr.from_tables(CATALOG, g.vertex_tables, plain, g.incidences(["Supply"]))
    return back.edge_tables["Supply"].groupBy("tail_order", "head_part", "head_supplier").agg(F.count(F.lit(1)).alias("n"))


@query("graph_export_tables", f"""WITH {VERTS} SELECT 'vertices' AS tbl, t AS type_id, count(*) AS n, 0::BIGINT AS empty_attributes FROM verts GROUP BY t
 UNION ALL SELECT 'edges', 'Supply', count(*), 0 FROM lineitem UNION ALL SELECT 'edges', 'Placed', count(*), count(*) FROM orders
 UNION ALL SELECT 'edges', 'LocatedIn', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'edges', 'Within', count(*), count(*) FROM nation""")
def export(spark, sf):
    t = gr.to_tables(graph(spark, sf))
    both = t["vertices"].select(F.lit("vertices").alias("tbl"), "type_id", "attributes").unionByName(t["edges"].select(F.lit("edges").alias("tbl"), "type_id", "attributes"))
    return both.groupBy("tbl", "type_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("attributes") == "{}").alias("empty_attributes"))


@query("graph_degree", f"WITH {VERTS}, {INC} SELECT id AS vertex_id, t AS type_id, coalesce(d, 0) AS degree FROM verts LEFT JOIN (SELECT v, count(DISTINCT e) AS d FROM inc GROUP BY v) ON v = id")
def degree(spark, sf):
    return graph(spark, sf).degree()


@query("graph_subtype_filter", "SELECT 'C:' || c_custkey AS vertex_id, 'Customer' AS type_id FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'Supplier' FROM supplier")
def subtype(spark, sf):
    return gr.subtype_filter(graph(spark, sf).vertices(), CATALOG.closure_df(spark), "Party")


@query("graph_subtype_closure", """WITH RECURSIVE e AS (SELECT 'N:' || n_nationkey AS c, 'R:' || n_regionkey AS p FROM nation UNION SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer),
 up(type_id, ancestor) AS (SELECT DISTINCT x, x FROM (SELECT c AS x FROM e UNION SELECT p FROM e) UNION SELECT up.type_id, e.p FROM up JOIN e ON up.ancestor = e.c) SELECT * FROM up""")
def closure(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    e = n.select(vid("N", "n_nationkey").alias("type_id"), vid("R", "n_regionkey").alias("parent")).unionByName(c.select(vid("C", "c_custkey").alias("type_id"), vid("N", "c_nationkey").alias("parent")))
    return gr.subtype_closure(e)


@query("graph_subtype_closure_deep", """WITH c AS (SELECT c_custkey AS k, c_custkey // 150 AS g FROM customer) SELECT a.k AS type_id, b.k AS ancestor FROM c a JOIN c b ON a.g = b.g AND b.k <= a.k""")
def deep_closure(spark, sf):
    """Chains of up to 150 types."""
    k = F.col("c_custkey")
    return gr.subtype_closure(table(spark, sf, "customer").select(k.alias("type_id"), F.when(k % 150 != 0, k - 1).otherwise(k).alias("parent")))


@query("graph_validate", """SELECT 'O:' || o_orderkey AS entity_id, 'not_a_choice' AS code, 'status' AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
 UNION ALL SELECT 'P:' || p_partkey, 'above_maximum', 'size' FROM part WHERE p_size > 48
 UNION ALL SELECT 'P:' || p_partkey, 'invariant', 'price > size + 900' FROM part WHERE NOT p_retailprice > p_size + 900
 UNION ALL SELECT 'C:' || c_custkey, 'below_minimum', 'balance' FROM customer WHERE c_acctbal < -900""")
def validate(spark, sf):
    return gr.validate_graph(graph(spark, sf))


@query("graph_materialize_attributes", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'O') AS status, 1.0::DOUBLE AS weight, CAST(NULL AS VARCHAR) AS note FROM orders")
def materialize(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    specs = {"status": gr.Attr("string", default="O"), "weight": gr.Attr("float", default=1.0), "note": gr.Attr("string", nullable=True)}
    return gr.materialize_attributes(o, specs).withColumn("note", F.col("note").cast("string"))


@query("graph_attribute_violations_typed", """SELECT l_orderkey::VARCHAR AS entity_id, 'above_maximum' AS code, 'l_quantity' AS detail FROM lineitem WHERE l_quantity > 49
 UNION ALL SELECT l_orderkey::VARCHAR, 'not_a_choice', 'l_linenumber' FROM lineitem WHERE l_linenumber NOT IN (1, 2, 3, 4, 5) UNION ALL SELECT l_orderkey::VARCHAR, 'not_a_choice', 'l_tax' FROM lineitem""")
def typed(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), "l_quantity", "l_linenumber", "l_tax")
    # the tax choices are integers: a double never equals one of them, whatever its value
    specs = {"l_quantity": gr.Attr("float", maximum=49.0), "l_linenumber": gr.Attr("int", choices=(1, 2, 3, 4, 5)), "l_tax": gr.Attr("float", choices=(0, 1))}
    return gr.attribute_violations(li, "k", specs)


@query("graph_immutable_violations", "SELECT 'C:' || c_custkey AS entity_id, 'immutable' AS code, 'segment' AS detail FROM customer WHERE c_custkey % 9 = 0 AND c_mktsegment <> 'BUILDING'")
def immutable(spark, sf):
    c = graph(spark, sf).vertex_tables["Customer"]
    k = F.substring("vertex_id", 3, 20).cast("long")
    after = c.withColumns({"segment": F.when(k % 9 == 0, "BUILDING").otherwise(F.col("segment")), "balance": F.col("balance") + 1})
    return gr.immutable_violations(c, after, "vertex_id", CATALOG.vertex_types["Customer"].attrs)


@query("graph_replace_keeps_immutable", """SELECT 'C:' || c_custkey AS vertex_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer""")
def replace(spark, sf):
    c = graph(spark, sf).vertex_tables["Customer"]
    upd = c.filter(F.substring("vertex_id", 3, 20).cast("long") % 4 == 0).select("vertex_id")
    return gr.replace_attributes(c, upd, "vertex_id", CATALOG.vertex_types["Customer"].attrs)


@query("graph_port_violations", f"""WITH x AS (SELECT {LINE_ID} AS e, l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem)
 SELECT e AS entity_id, 'below_port_minimum' AS code, 'tail.order' AS detail FROM x WHERE o % 50 = 0 UNION ALL SELECT e, 'unknown_role', 'head.helper' FROM x WHERE o % 50 = 1
 UNION ALL SELECT e, 'above_port_maximum', 'head.part' FROM x WHERE o % 50 = 2 UNION ALL SELECT e, 'unknown_vertex', 'S:none' FROM x WHERE o % 50 = 3
 UNION ALL SELECT e, 'incompatible_vertex', 'P:' || p FROM x WHERE o % 50 = 4""")
def ports(spark, sf):
    g = graph(spark, sf)
    inc = g.incidences(["Supply"]).drop("edge_type")
    k = F.split("edge_id", ":")[1].cast("long") % 50
    part = lambda: F.concat(F.lit("P:"), F.split("edge_id", ":")[3])
    broken = inc.filter(~((k == 0) & (F.col("role") == "order")))
    broken = broken.withColumn("vertex_id", F.when((k == 3) & (F.col("role") == "supplier"), "S:none").when((k == 4) & (F.col("role") == "supplier"), part()).otherwise(F.col("vertex_id")))
    extra = inc.filter((F.col("role") == "part") & k.isin(1, 2)).withColumn("role", F.when(k == 1, "helper").otherwise("part"))
    edges = g.edge_tables["Supply"].select("edge_id", F.lit("Supply").alias("type_id"))
    return gr.port_violations(edges, broken.unionByName(extra), g.vertices(), CATALOG.ports_df(spark), CATALOG.closure_df(spark))


@query("graph_index_violations", """SELECT 'O:' || o_orderkey AS entity_id, 'id_shared' AS code, '2' AS detail FROM orders WHERE o_orderkey % 100 = 0
 UNION ALL SELECT 'C:' || c_custkey, 'id_duplicate', '2' FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT 'gone:' || o_orderkey, 'orphan_incidence', 'O:' || o_orderkey FROM orders WHERE o_orderkey % 100 = 1""")
def index(spark, sf):
    g = graph(spark, sf)
    v, e, inc = g.vertices(), g.edges(), g.incidences(["Placed"])
    key = lambda c: F.split(c, ":")[1].cast("long") % 100
    v = v.unionByName(v.filter((F.col("type_id") == "Customer") & (key("vertex_id") == 0)))
    e = e.unionByName(v.filter((F.col("type_id") == "Order") & (key("vertex_id") == 0)).select(F.col("vertex_id").alias("edge_id"), F.lit("Placed").alias("type_id")))
    stray = inc.filter((F.col("role") == "order") & (key("vertex_id") == 1)).withColumn("edge_id", F.concat(F.lit("gone:"), F.split("vertex_id", ":")[1]))
    return gr.index_violations(v, e, inc.unionByName(stray))


@query("graph_resource_limits", f"WITH {VERTS}, {INC} SELECT 'vertices' AS resource, count(*) AS used, 100::BIGINT AS allowed, true AS exceeded FROM verts UNION ALL SELECT 'edges', count(DISTINCT e), NULL, false FROM inc UNION ALL SELECT 'incidences', count(*), 1000000000000, false FROM inc")
def limits(spark, sf):
    return gr.resource_limits(graph(spark, sf), vertices=100, incidences=10**12)


@query("graph_entity_count_and_sum", f"SELECT (SELECT count(*) FROM part WHERE p_size = 7) AS parts_of_size_7, 0::BIGINT AS parts_of_size_7_as_float, (SELECT {q6('sum(c_acctbal)', 3)} FROM customer) AS balance")
def counts(spark, sf):
    g = graph(spark, sf)
    p = g.vertex_tables["Part"]
    a = gr.entity_count(p, {"size": 7}).select(F.col("count").alias("parts_of_size_7"), F.lit(1).alias("k"))
    b = gr.entity_count(p, {"size": 7.0}).select(F.col("count").alias("parts_of_size_7_as_float"), F.lit(1).alias("k"))
    c = gr.attribute_sum(g.vertex_tables["Customer"], "balance").select(r6("total", 3).alias("balance"), F.lit(1).alias("k"))
    return a.join(b, "k").join(c, "k").drop("k")


@query("graph_structural_features", f"""WITH {TRADE}, s AS (SELECT a AS v FROM trade UNION ALL SELECT b FROM trade), q AS (SELECT a AS v, qty FROM trade UNION ALL SELECT b, qty FROM trade)
SELECT 'N:' || n_nationkey AS vertex_id, 'Nation' AS type_id, 0.0::DOUBLE AS type_party, 1.0::DOUBLE AS type_nation, (SELECT count(*) FROM s WHERE v = 'N:' || n_nationkey) / 4.0 AS path_degree,
 (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) / 6.0 AS located, {q6("coalesce((SELECT avg(qty) FROM q WHERE v = 'N:' || n_nationkey), 0)")} AS mean_path_quality FROM nation""")
def features(spark, sf):
    g = graph(spark, sf)
    ends = trade_ends(spark, sf)
    both = ends.select(F.explode(F.array("a", "b")).alias("vertex_id"), "qty")
    located = table(spark, sf, "customer").select(vid("N", "c_nationkey").alias("vertex_id"))
    nations = g.vertex_tables["Nation"].select("vertex_id", F.lit("Nation").alias("type_id"))
    got = gr.structural_features(nations, {"type_party": ["Customer", "Supplier"], "type_nation": ["Nation"]}, {"path_degree": (both, 4.0), "located": (located, 6.0)}, {"mean_path_quality": (both, "qty")})
    return got.withColumn("mean_path_quality", r6("mean_path_quality"))


@query("graph_relation_adjacency", f"""WITH {TRADE}, l AS (SELECT a AS src, b AS dst FROM trade WHERE a <> b UNION ALL SELECT b, a FROM trade WHERE a <> b), w AS (SELECT src, dst, count(*) AS w FROM l GROUP BY ALL)
SELECT 'trade' AS relation, dst, src, {q6('w / sum(w) OVER (PARTITION BY dst)', 9)} AS weight FROM w""")
def adjacency(spark, sf):
    links = gr.project_members(trade_ends(spark, sf), ["a", "b"], "trade", F.lit(1.0))
    return gr.relation_adjacency(links).withColumn("weight", r6("weight", 9))


@query("graph_clique_projection", f"""WITH x AS (SELECT 'O:' || l_orderkey AS o, 'P:' || l_partkey AS p, 'S:' || l_suppkey AS s FROM lineitem)
SELECT src, dst, count(*) AS n FROM (SELECT o AS src, p AS dst FROM x UNION ALL SELECT o, s FROM x UNION ALL SELECT p, s FROM x) GROUP BY ALL""")
def clique(spark, sf):
    e = graph(spark, sf).edge_tables["Supply"]
    return gr.project_members(e, ["tail_order", "head_part", "head_supplier"], "supply", F.lit(1.0)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("graph_affected_mask", f"""SELECT {LINE_ID} AS event_id, unnest(CASE WHEN l_returnflag = 'R' THEN ['o', 's'] WHEN l_returnflag = 'A' THEN ['o'] END) AS key,
 unnest(CASE WHEN l_returnflag = 'R' THEN ['O:' || l_orderkey, 'S:' || l_suppkey] WHEN l_returnflag = 'A' THEN ['O:' || l_orderkey] END) AS entity_id FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def affected(spark, sf):
    li = table(spark, sf, "lineitem")
    ev = li.select(line_id().alias("event_id"), F.col("l_returnflag").alias("rule_id"), F.create_map(F.lit("o"), vid("O", "l_orderkey"), F.lit("p"), vid("P", "l_partkey"), F.lit("s"), vid("S", "l_suppkey")).alias("vertex_map"))
    return gr.affected_mask(ev, {"R": ("o", "s"), "A": ("o",)})


@query("graph_cell_load", f"SELECT c_nationkey AS cell, count(*) AS members, {q6('least(count(*) / greatest((SELECT count(*) FROM customer) / 2, 1), 1.5)', 9)} AS load FROM customer GROUP BY 1")
def cell_load(spark, sf):
    return gr.cell_load(table(spark, sf, "customer").select(F.col("c_nationkey").alias("cell")), "cell").withColumn("load", r6("load", 9))


@query("graph_head_mask", "SELECT 'P:' || p_partkey AS vertex_id, p_size > 25 AS failure, p_size <= 25 AS recovery, true AS service FROM part")
def head_mask(spark, sf):
    return gr.head_mask(graph(spark, sf).vertex_tables["Part"], {"failure": F.col("size") > 25, "recovery": F.col("size") <= 25, "service": F.lit(True)})


@query("radio_link_quality", f"""WITH r AS (SELECT l_partkey AS ue, l_suppkey AS cell, -80 - max(l_extendedprice) / 10000 AS rsrp FROM lineitem GROUP BY ALL),
 j AS (SELECT ue, cell, rsrp, pow(10, rsrp / 10) AS lin, sum(pow(10, rsrp / 10)) OVER (PARTITION BY ue) AS tot, row_number() OVER (PARTITION BY ue ORDER BY rsrp DESC) AS rk, max(rsrp) OVER (PARTITION BY ue) AS best,
  nth_value(rsrp, 2) OVER (PARTITION BY ue ORDER BY rsrp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM r),
 s AS (SELECT *, 10 * log10(lin / (greatest(tot - lin, 0) + pow(10, -9.5)) + 1e-15) AS sinr FROM j), c AS (SELECT *, greatest(1, least(15, floor((sinr + 7) / 2) + 1))::DOUBLE AS cqi FROM s)
SELECT ue, cell, {q6('sinr', 4)} AS sinr_db, cqi, {q6('least(7.4, greatest(0.05, log2(1 + pow(10, sinr / 10) / 1.5)))', 4)} AS spectral_efficiency,
 {q6('1 / (1 + exp((sinr - (-5.0 + 1.35 * cqi)) / 1.8))', 4)} AS bler_proxy, {q6('coalesce(CASE WHEN rk = 1 THEN second ELSE best END - rsrp, -30)', 7)} AS neighbour_margin_db FROM c""")
def links(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("ue"), F.col("l_suppkey").alias("cell")).agg((-80 - F.max("l_extendedprice") / 10000).alias("rsrp_dbm"))
    got = gr.link_quality(r).drop("rsrp_dbm")
    return got.withColumns({**{c: r6(c, 4) for c in ("sinr_db", "spectral_efficiency", "bler_proxy")}, "neighbour_margin_db": r6("neighbour_margin_db", 7)})


@query("runs_union_of_controls", "SELECT src, count(*) AS n, count(x) AS with_x FROM (SELECT 'c' AS src, c_acctbal AS x FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier UNION ALL SELECT 'n', NULL FROM nation) GROUP BY src")
def controls(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("c").alias("src"), F.col("c_acctbal").alias("x"))
    b = table(spark, sf, "supplier").select(F.lit("s").alias("src"), F.col("s_acctbal").alias("x"))
    c = table(spark, sf, "nation").select(F.lit("n").alias("src"))
    return rs.union_shards([a, b, c]).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("with_x"))
