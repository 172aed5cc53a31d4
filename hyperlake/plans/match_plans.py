"""Registered queries: patterns, conditions, anchors and match deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as mt
from ..operators.match import ANY, E, NAC, PAC, Pattern, V, Var
from .data import table
from .registry import query
from .tpch_graph import LINE_ID, TRADE, graph

SUPPLY = E("l", "Supply", tail={"order": ["o"]}, head={"part": ["p"], "supplier": ["s"]})
SAME_NATION = Pattern(
    [V("o", "Order"), V("p", "Part"), V("s", "Supplier"), V("c", "Customer"), V("n", "Nation")],
    [SUPPLY, E("pl", "Placed", tail={"customer": ["c"]}, head={"order": ["o"]}),
     E("li", "LocatedIn", tail={"party": ["c"]}, head={"nation": ["n"]}), E("ls", "LocatedIn", tail={"party": ["s"]}, head={"nation": ["n"]})],
)
RETURNED = Pattern([V("o", "Order"), V("p", "Part"), V("s", "Supplier")], [E("r", "Supply", tail={"order": ["o"]}, head={"part": ["p"], "supplier": ["s"]}, attrs={"flag": "R"})])
LINES = f"ln AS (SELECT {LINE_ID} AS e, 'O:' || l_orderkey AS o, 'P:' || l_partkey AS p, 'S:' || l_suppkey AS s, * FROM lineitem)"
SAME = f"""{LINES}, same AS (SELECT e AS e_l, o AS v_o, p AS v_p, s AS v_s, 'C:' || o_custkey AS v_c, 'N:' || c_nationkey AS v_n, l_quantity, l_orderkey
 FROM ln JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey)"""
COLS = ["e_l", "v_o", "v_p", "v_s", "v_c", "v_n"]


@query("match_same_nation_supply_without_return", f"WITH {SAME} SELECT {', '.join(COLS)} FROM same WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = same.l_orderkey AND r.l_returnflag = 'R')")
def flagship(spark, sf):
    return mt.matches(graph(spark, sf), SAME_NATION, conditions=[NAC(RETURNED, {"o": "o"})]).select(*COLS)


@query("match_two_edge_path", f"WITH {SAME} SELECT {', '.join(COLS)} FROM same")
def path(spark, sf):
    return mt.matches(graph(spark, sf), SAME_NATION).select(*COLS)


@query("match_positive_condition", f"WITH {SAME} SELECT {', '.join(COLS)} FROM same WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = same.l_orderkey AND r.l_returnflag = 'R')")
def pac(spark, sf):
    return mt.matches(graph(spark, sf), SAME_NATION, conditions=[PAC(RETURNED, {"o": "o"})]).select(*COLS)


@query("match_condition_guard_on_base_binding", f"""WITH {LINES} SELECT e AS e_l, o AS v_o FROM ln WHERE l_returnflag = 'A'
 AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = ln.l_orderkey AND r.l_returnflag = 'R' AND r.l_quantity > ln.l_quantity)""")
def nac_guard(spark, sf):
    base = Pattern(RETURNED.vertices, [E("l", "Supply", SUPPLY.tail, SUPPLY.head, {"flag": "A", "qty": Var("q")})])
    return mt.matches(graph(spark, sf), base, conditions=[NAC(RETURNED, {"o": "o"}, guard="r__qty > b_q")]).select("e_l", "v_o")


@query("match_guard_with_parameters", f"WITH {SAME} SELECT {', '.join(COLS)} FROM same JOIN part ON v_p = 'P:' || p_partkey WHERE l_quantity * 2.5 > p_size + 10")
def guard(spark, sf):
    got = mt.matches(graph(spark, sf), SAME_NATION, guard="l__qty * p_gain > p__size + p_base", parameters={"gain": 2.5, "base": 10.0})
    return got.select(*COLS)


@query("match_guard_comparisons", f"""WITH {SAME} SELECT {', '.join(COLS)} FROM same JOIN part ON v_p = 'P:' || p_partkey JOIN orders ON v_o = 'O:' || o_orderkey
 WHERE floor(l_quantity / 3) >= floor(p_size / 2) AND o_orderstatus <> 'P' AND (p_size <= 20 OR NOT p_brand = 'Brand#12') AND l_quantity >= 2 AND l_quantity < p_retailprice AND (p_size - 25) ** 2 >= 1""")
def comparisons(spark, sf):
    text = "l__qty // 3 >= p__size // 2 and o__status <> 'P' and (p__size <= 20 or not p__brand == 'Brand#12') and p_low <= l__qty < p__price and (p__size - 25) ** 2 >= 1"
    return mt.matches(graph(spark, sf), SAME_NATION, guard=text, parameters={"low": 2}).select(*COLS)


@query("match_literals_any_and_variables", """SELECT 'P:' || p_partkey AS v_p, 'O:' || o_orderkey AS v_o, l_quantity AS b_q, p_brand AS b_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
 WHERE p_size = 7 AND o_orderstatus = 'F' GROUP BY ALL""")
def literals(spark, sf):
    p = Pattern([V("o", "Order", {"status": "F"}), V("p", "Part", {"size": 7, "brand": Var("brand")}), V("s", "Supplier")],
                [E("l", "Supply", SUPPLY.tail, SUPPLY.head, {"qty": Var("q"), "flag": ANY})])
    return mt.matches(graph(spark, sf), p).groupBy("v_p", "v_o", "b_q", "b_brand").agg(F.count(F.lit(1)).alias("n"))


@query("match_variable_unification", """SELECT 'O:' || a.l_orderkey AS v_o, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity = b.l_quantity
 WHERE a.l_partkey <> b.l_partkey AND a.l_suppkey <> b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' GROUP BY ALL""")
def unify(spark, sf):
    p = Pattern([V("o", "Order"), V("p", "Part"), V("q", "Part"), V("s", "Supplier"), V("t", "Supplier")],
                [E("a", "Supply", {"order": ["o"]}, {"part": ["p"], "supplier": ["s"]}, {"flag": "A", "qty": Var("x")}),
                 E("b", "Supply", {"order": ["o"]}, {"part": ["q"], "supplier": ["t"]}, {"flag": "R", "qty": Var("x")})])
    return mt.matches(graph(spark, sf), p).groupBy("v_o").agg(F.count(F.lit(1)).alias("n"))


@query("match_typed_literal_never_coerces", f"WITH {LINES} SELECT count(*) AS float_literal, 0::BIGINT AS int_literal FROM ln WHERE l_quantity = 7.0")
def typed(spark, sf):
    g = graph(spark, sf)

    def n(value, name):
        p = Pattern(RETURNED.vertices, [E("l", "Supply", SUPPLY.tail, SUPPLY.head, {"qty": value})])
        return mt.matches(g, p).agg(F.count(F.lit(1)).alias(name), F.lit(1).alias("k"))

    return n(7.0, "float_literal").join(n(7, "int_literal"), "k").drop("k")


@query("match_unordered_role", f"""WITH {TRADE}, m AS (SELECT id, a AS x, b AS y FROM trade WHERE a <> b UNION ALL SELECT id, b, a FROM trade WHERE a <> b)
 SELECT 'T' || id AS e_t, x AS v_x, y AS v_y FROM m WHERE x = 'N:3'""")
def unordered(spark, sf):
    p = Pattern([V("x", "Nation", {"name": "NATION_3"}), V("y", "Nation")], [E("t", "Trade", tail={"members": ["x", "y"]})])
    return mt.matches(graph(spark, sf, True), p).select("e_t", "v_x", "v_y")


@query("match_ordered_role", f"WITH {TRADE} SELECT 'RT' || id AS e_t, a AS v_x, b AS v_y FROM trade WHERE a <> b AND a = 'N:3'")
def ordered(spark, sf):
    p = Pattern([V("x", "Nation", {"name": "NATION_3"}), V("y", "Nation")], [E("t", "Route", tail={"path": ["x", "y"]})])
    return mt.matches(graph(spark, sf, True), p).select("e_t", "v_x", "v_y")


@query("match_repeated_endpoint", f"WITH {TRADE} SELECT 'T' || id AS e_t, a AS v_x FROM trade WHERE a = b")
def repeated(spark, sf):
    p = Pattern([V("x", "Nation")], [E("t", "Trade", tail={"members": ["x", "x"]})])
    return mt.matches(graph(spark, sf, True), p).select("e_t", "v_x")


@query("match_anchored", f"WITH {SAME} SELECT {', '.join(COLS)} FROM same JOIN customer ON v_c = 'C:' || c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def anchored(spark, sf):
    g = graph(spark, sf)
    a = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("v_c"))
    return mt.matches(g, SAME_NATION, anchors=a).select(*COLS)


@query("match_subtypes_of_party", """SELECT 'R:' || n_regionkey AS v_r, p AS v_p FROM nation JOIN (SELECT 'C:' || c_custkey AS p, c_nationkey AS n FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_nationkey FROM supplier) ON n = n_nationkey""")
def subtypes(spark, sf):
    p = Pattern([V("p", "Party"), V("n", "Nation"), V("r", "Region")], [E("a", "LocatedIn", {"party": ["p"]}, {"nation": ["n"]}), E("b", "Within", {"nation": ["n"]}, {"region": ["r"]})])
    return mt.matches(graph(spark, sf), p).select("v_r", "v_p")


@query("match_id_distinct", f"WITH {SAME} SELECT v_n, count(DISTINCT (e_l, v_o)) AS n FROM same GROUP BY v_n")
def ids(spark, sf):
    m = mt.matches(graph(spark, sf), SAME_NATION, rule_id="same")
    twice = m.unionByName(m)
    return mt.distinct_matches(twice).groupBy("v_n").agg(F.count(F.lit(1)).alias("n"))


def _relations(spark, sf):
    """Matches before and after the A-lines of every seventh order turn into N-lines."""
    g = graph(spark, sf)
    flagged = Pattern(RETURNED.vertices, [E("l", "Supply", SUPPLY.tail, SUPPLY.head, {"flag": "A"})])
    before = mt.matches(g, flagged, rule_id="a").select("v_o", "v_p", "v_s", "e_l", "match_id")
    g2 = graph(spark, sf)
    k = F.substring("tail_order", 3, 20).cast("long")
    s = g2.edge_tables["Supply"]
    g2.edge_tables["Supply"] = s.withColumn("flag", F.when((k % 7 == 0) & (F.col("flag") == "A"), "N").when((k % 7 == 1) & (F.col("flag") == "R"), "A").otherwise(F.col("flag")))
    touched = s.filter(((k % 7 == 0) & (F.col("flag") == "A")) | ((k % 7 == 1) & (F.col("flag") == "R")) | ((k % 7 == 2) & (F.col("flag") == "A"))).select(F.col("edge_id").alias("entity_id"))
    return g2, flagged, before, touched


@query("match_localized_rematch", f"WITH {LINES} SELECT e AS e_l FROM ln WHERE (l_returnflag = 'A' AND l_orderkey % 7 <> 0) OR (l_returnflag = 'R' AND l_orderkey % 7 = 1)")
def rematch(spark, sf):
    g2, p, before, touched = _relations(spark, sf)
    return mt.rematch(g2, p, before, touched, rule_id="a").select("e_l")


@query("match_delta_classes", """SELECT change, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' AND l_orderkey % 7 = 0 THEN 'removed' WHEN l_returnflag = 'R' AND l_orderkey % 7 = 1 THEN 'added'
  WHEN l_returnflag = 'A' AND l_orderkey % 7 = 2 THEN 'revalidated' WHEN l_returnflag = 'A' THEN 'kept' END AS change FROM lineitem) WHERE change IS NOT NULL GROUP BY change""")
def delta(spark, sf):
    g2, p, before, touched = _relations(spark, sf)
    after = mt.matches(g2, p, rule_id="a").select("v_o", "v_p", "v_s", "e_l", "match_id")
    return mt.match_delta(before, after, mt.touched_matches(before, p, touched)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("match_relations_differ", f"WITH {LINES} SELECT e AS e_l, CASE WHEN l_returnflag = 'A' THEN 'left' ELSE 'right' END AS side FROM ln WHERE (l_returnflag = 'A' AND l_orderkey % 7 = 0) OR (l_returnflag = 'R' AND l_orderkey % 7 = 1)")
def differ(spark, sf):
    g2, p, before, touched = _relations(spark, sf)
    after = mt.rematch(g2, p, before, touched, rule_id="a")
    return mt.difference(before, after).select("e_l", "side")
