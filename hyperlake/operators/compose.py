"""Composition of component graphs by identifying wired boundary vertices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def wire_pairs(wires: DataFrame, handles: DataFrame, vertices: DataFrame, closure: DataFrame) -> DataFrame:
    """Vertex pairs a wire identifies, with ``problem`` where it is illegal.

    wires: left_component, left_handle, right_component, right_handle; handles:
    component, handle_id, direction, binding; vertices: component, vertex_id, type_id.
    """
    side = lambda s: handles.select(
        F.col("component").alias(f"{s}_component"), F.col("handle_id").alias(f"{s}_handle"), F.col("direction").alias(f"{s}_direction"), F.col("binding").alias(f"{s}_vertex"), F.lit(True).alias(f"_{s}"))
    w = wires.join(side("left"), ["left_component", "left_handle"], "left").join(side("right"), ["right_component", "right_handle"], "left")
    typed = lambda s: vertices.select(F.col("component").alias(f"{s}_component"), F.col("vertex_id").alias(f"{s}_vertex"), F.col("type_id").alias(f"{s}_type"))
    w = w.join(typed("left"), ["left_component", "left_vertex"], "left").join(typed("right"), ["right_component", "right_vertex"], "left")
    up = lambda a, b, n: closure.select(F.col("type_id").alias(a), F.col("ancestor").alias(b), F.lit(True).alias(n))
    w = w.join(up("left_type", "right_type", "_lr"), ["left_type", "right_type"], "left").join(up("right_type", "left_type", "_rl"), ["left_type", "right_type"], "left")
    same = F.col("left_direction") == F.col("right_direction")
    problem = (
        F.when(F.col("_left").isNull() | F.col("_right").isNull(), "unknown_handle").when(F.col("left_vertex").isNull() | F.col("right_vertex").isNull(), "unbound_handle")
        .when(same & F.col("left_direction").isin("input", "output"), "incompatible_directions").when(F.col("_lr").isNull() & F.col("_rl").isNull(), "incompatible_types")
    )
    return w.select(*wires.columns, "left_vertex", "right_vertex", problem.alias("problem"))


def connected_components(nodes: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over undirected links.

    Every node points at its smallest neighbour if that is smaller than itself,
    pointers are followed for a few steps, and the links are drawn again between
    the nodes pointed at.  At least half of the nodes with links go in two rounds,
    and links that fall together or into a node go with them, so later rounds are
    small.  The pointers of the rounds, put one after the other, lead to the
    smallest node.  A hub sends one combined minimum per round (map-side).

    Without ``nodes`` the ends of all links are the nodes; else links to other
    nodes are left out.
    """
    if nodes is not None:
        known = nodes.select("node").distinct()
        for c in ("a", "b"):
            links = links.join(known.withColumnRenamed("node", c), c, "left_semi")
    else:
        links = cut(links.select("a", "b"))
        nodes = links.select(F.col("a").alias("node")).distinct().union(links.select("b").distinct()).distinct()
    falling = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a link given twice changes no minimum, so links are made distinct only once they are drawn again
    edges = cut(falling(links))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        up = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        # a chain of up to four pointers is followed to its end; of a longer one the rest stays as links
        for _ in range(2):
            up = cut(_follow(up, up, "root"))
        rounds.append(up)
        edges = cut(falling(_follow(_follow(edges, up, "a"), up, "b")).distinct())
    if not rounds:
        return nodes.select("node", F.col("node").alias("root"))
    whole = rounds.pop()
    while rounds:
        # whoever a round left standing may have gone in a later one
        earlier = rounds.pop()
        whole = cut(_follow(earlier, whole, "root").unionByName(whole.join(earlier, "node", "left_anti")))
    return nodes.join(whole, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _follow(df: DataFrame, pointers: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by what it points at, if anything."""
    at = pointers.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
    return df.join(at, F.col(column) == F.col("_at"), "left").withColumn(column, F.coalesce("_to", column)).drop("_at", "_to")


def merge_vertices(members: DataFrame, attributes: Sequence[str], depth: Mapping[str, int], merge: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): one vertex per root with its most specific type.

    ``members``: root, node, type_id, attributes.  ``depth`` is the number of
    ancestors per type; wired types are comparable, so the deepest is the most
    specific.  Unless ``merge`` names an aggregate, differing values conflict.
    """
    level = F.create_map(*[x for t, d in depth.items() for x in (F.lit(t), F.lit(d))])[F.col("type_id")]
    merge = dict(merge or {})
    aggs = [F.max_by("type_id", F.struct(level, "type_id")).alias("type_id"), F.count(F.lit(1)).alias("members")]
    for a in attributes:
        aggs.append(merge[a].alias(a) if a in merge else F.min(a).alias(a))
        if a not in merge:
            # min and max differ exactly when two values differ; nothing is collected
            aggs.append((F.min(a) != F.max(a)).alias(f"_c_{a}"))
    got = members.groupBy("root").agg(*aggs)
    plain = [a for a in attributes if a not in merge]
    hits = F.filter(F.array(*[F.when(F.col(f"_c_{a}"), F.lit(a)) for a in plain]), lambda x: x.isNotNull()) if plain else None
    merged = got.drop(*[f"_c_{a}" for a in plain])
    if hits is None:
        return merged, got.select("root", F.lit("").alias("attribute")).limit(0)
    return merged, got.select("root", F.explode(hits).alias("attribute"))


def remap_endpoints(edges: DataFrame, columns: Sequence[str], mapping: DataFrame, component: str = "component") -> DataFrame:
    """Replace endpoint columns through (component, vertex_id) -> root."""
    out = edges
    for c in columns:
        m = mapping.select(F.col("component").alias(component), F.col("vertex_id").alias(c), F.col("root").alias("_new"))
        out = out.join(m, [component, c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out


def remaining_handles(handles: DataFrame, wires: DataFrame, mapping: DataFrame, retain: bool = False) -> DataFrame:
    """Handles of the composite: prefixed by component, rebound, wired ones dropped."""
    h = handles
    if not retain:
        used = wires.select(F.col("left_component").alias("component"), F.col("left_handle").alias("handle_id")).union(wires.select("right_component", "right_handle"))
        h = h.join(used.distinct(), ["component", "handle_id"], "left_anti")
    m = mapping.select("component", F.col("vertex_id").alias("binding"), F.col("root").alias("_new"))
    h = h.join(m, ["component", "binding"], "left")
    return h.select(F.concat_ws("::", "component", "handle_id").alias("handle_id"), "component", "direction", F.coalesce("_new", "binding").alias("binding"))


def compose(vertices: DataFrame, wires: DataFrame, handles: DataFrame, closure: DataFrame, attributes: Sequence[str], depth: Mapping[str, int], merge: Mapping[str, Column] | None = None) -> dict[str, DataFrame]:
    """Composite tables: mapping, vertices, conflicts, handles and illegal wires."""
    pairs = cut(wire_pairs(wires, handles, vertices, closure))
    key = lambda c, v: F.concat_ws("::", c, v)
    nodes = vertices.withColumn("node", key("component", "vertex_id"))
    links = pairs.filter("problem IS NULL").select(key("left_component", "left_vertex").alias("a"), key("right_component", "right_vertex").alias("b"))
    # only wired vertices enter the iteration; all others are their own root
    roots = connected_components(None, links)
    mapping = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    merged, conflicts = merge_vertices(mapping, attributes, depth, merge)
    return {
        "mapping": mapping.select("component", "vertex_id", "root"), "vertices": merged, "conflicts": conflicts,
        "handles": remaining_handles(handles, wires, mapping), "illegal_wires": pairs.filter("problem IS NOT NULL"),
    }
