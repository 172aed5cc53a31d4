"""The given tables as a typed hypergraph, with the catalogue that describes it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import Attr, Catalog, EdgeType, Graph, Port, VertexType
from .data import table

F_ = lambda **kw: Attr("float", **kw)
S_ = lambda **kw: Attr("string", **kw)
I_ = lambda **kw: Attr("int", **kw)

CATALOG = Catalog(
    [
        VertexType("Party"),
        VertexType("Customer", ("Party",), {"balance": F_(minimum=-900.0), "segment": S_(required=True, mutable=False)}),
        VertexType("Supplier", ("Party",), {"balance": F_()}),
        VertexType("Part", (), {"size": I_(minimum=1, maximum=48), "brand": S_(), "price": F_(minimum=0.0)}, invariants=("price > size + 900",)),
        VertexType("Order", (), {"status": S_(choices=("F", "O")), "total": F_(), "priority": S_()}),
        VertexType("Nation", (), {"name": S_(required=True)}),
        VertexType("Region", (), {"name": S_(required=True)}),
    ],
    [
        EdgeType("Supply", (Port("tail", "order", "Order"), Port("head", "part", "Part"), Port("head", "supplier", "Supplier")),
                 {"qty": F_(), "price": F_(), "discount": F_(), "flag": S_()}),
        EdgeType("Placed", (Port("tail", "customer", "Customer"), Port("head", "order", "Order"))),
        EdgeType("LocatedIn", (Port("tail", "party", "Party"), Port("head", "nation", "Nation"))),
        EdgeType("Within", (Port("tail", "nation", "Nation"), Port("head", "region", "Region"))),
        EdgeType("Trade", (Port("tail", "members", "Nation", 2, 2, ordered=False, repeated=True),), {"qty": F_()}),
        EdgeType("Route", (Port("tail", "path", "Nation", 2, 2, ordered=True, repeated=True),), {"qty": F_()}),
    ],
)

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def line_id():
    """The six columns that identify an order line."""
    return F.concat_ws(":", F.lit("L"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate")), F.round(F.col("l_extendedprice") * 100).cast("long"))


LINE_ID = "concat_ws(':', 'L', l_orderkey, l_linenumber, l_partkey, l_suppkey, datediff('day', DATE '1970-01-01', l_shipdate::DATE), round(l_extendedprice * 100)::BIGINT)"


def vid(prefix: str, col: str):
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


def graph(spark, sf, with_trade: bool = False) -> Graph:
    t = lambda n: table(spark, sf, n)
    v = {
        "Customer": t("customer").select(vid("C", "c_custkey").alias("vertex_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "Supplier": t("supplier").select(vid("S", "s_suppkey").alias("vertex_id"), F.col("s_acctbal").alias("balance")),
        "Part": t("part").select(vid("P", "p_partkey").alias("vertex_id"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")),
        "Order": t("orders").select(vid("O", "o_orderkey").alias("vertex_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority")),
        "Nation": t("nation").select(vid("N", "n_nationkey").alias("vertex_id"), F.col("n_name").alias("name")),
        "Region": t("region").select(vid("R", "r_regionkey").alias("vertex_id"), F.col("r_name").alias("name")),
    }
    located = t("customer").select(vid("C", "c_custkey").alias("p"), "c_nationkey").unionByName(
        t("supplier").select(vid("S", "s_suppkey").alias("p"), F.col("s_nationkey").alias("c_nationkey")))
    e = {
        "Supply": t("lineitem").select(line_id().alias("edge_id"), vid("O", "l_orderkey").alias("tail_order"), vid("P", "l_partkey").alias("head_part"), vid("S", "l_suppkey").alias("head_supplier"),
                                       F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag")),
        "Placed": t("orders").select(vid("PL", "o_orderkey").alias("edge_id"), vid("C", "o_custkey").alias("tail_customer"), vid("O", "o_orderkey").alias("head_order")),
        "LocatedIn": located.select(F.concat(F.lit("LI:"), "p").alias("edge_id"), F.col("p").alias("tail_party"), vid("N", "c_nationkey").alias("head_nation")),
        "Within": t("nation").select(vid("W", "n_nationkey").alias("edge_id"), vid("N", "n_nationkey").alias("tail_nation"), vid("R", "n_regionkey").alias("head_region")),
    }
    if with_trade:
        ends = trade_ends(spark, sf)
        e["Trade"] = ends.select(F.concat(F.lit("T"), "id").alias("edge_id"), F.array("a", "b").alias("tail_members"), "qty")
        e["Route"] = ends.select(F.concat(F.lit("RT"), "id").alias("edge_id"), F.array("a", "b").alias("tail_path"), "qty")
    return Graph(CATALOG, v, e)


def trade_ends(spark, sf):
    """Customer nation and supplier nation of every order line."""
    t = lambda n: table(spark, sf, n)
    li = t("lineitem").select(line_id().alias("id"), "l_orderkey", "l_suppkey", F.col("l_quantity").alias("qty"))
    o = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = t("supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select("id", vid("N", "c_nationkey").alias("a"), vid("N", "s_nationkey").alias("b"), "qty")


TRADE = f"""trade AS (SELECT {LINE_ID} AS id, 'N:' || c_nationkey AS a, 'N:' || s_nationkey AS b, l_quantity AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
