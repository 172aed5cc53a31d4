"""Typed sub-graph patterns compiled to join plans.

A pattern edge is one scan of its edge table with the endpoints laid out in
columns; pattern vertices join only where their attributes or an unproven type
require it.  Injectivity becomes inequality filters between keys whose types
overlap.  Positive and negative conditions are semi and anti joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..session import cut
from .graph import Graph, _same_kind


@dataclass(frozen=True)
class Var:
    """Binds an attribute value; every use of the name must agree in type and value."""

    name: str


class _Any:
    def __repr__(self) -> str:
        return "ANY"


ANY = _Any()


@dataclass(frozen=True)
class V:
    key: str
    type: str
    attrs: Mapping[str, Any] = field(default_factory=dict)
    subtypes: bool = True


@dataclass(frozen=True)
class E:
    key: str
    type: str
    tail: Mapping[str, Sequence[str]] = field(default_factory=dict)
    head: Mapping[str, Sequence[str]] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)

    def slots(self) -> list[tuple[str, str, tuple[str, ...]]]:
        return [(s, r, tuple(ks)) for s, m in (("tail", self.tail), ("head", self.head)) for r, ks in m.items()]

    def endpoints(self) -> list[str]:
        return list(dict.fromkeys(k for _, _, ks in self.slots() for k in ks))


@dataclass(frozen=True)
class Pattern:
    vertices: Sequence[V]
    edges: Sequence[E] = ()

    def __post_init__(self) -> None:
        keys = [v.key for v in self.vertices] + [e.key for e in self.edges]
        if len(keys) != len(set(keys)):
            raise ValueError("pattern keys must be unique across vertices and edges")
        known = {v.key for v in self.vertices}
        for e in self.edges:
            unknown = set(e.endpoints()) - known
            if unknown:
                raise ValueError(f"edge {e.key} has ends that are no vertices of its pattern: {sorted(unknown)}")


@dataclass(frozen=True)
class Condition:
    """An extension that must (PAC) or must not (NAC) exist.

    ``shared_vertices`` / ``shared_edges`` map condition keys to base keys.
    """

    pattern: Pattern
    positive: bool
    shared_vertices: Mapping[str, str] = field(default_factory=dict)
    shared_edges: Mapping[str, str] = field(default_factory=dict)
    guard: str | None = None


def PAC(pattern: Pattern, shared_vertices: Mapping[str, str] = {}, shared_edges: Mapping[str, str] = {}, guard: str | None = None) -> Condition:  # noqa: N802
    return Condition(pattern, True, shared_vertices, shared_edges, guard)


def NAC(pattern: Pattern, shared_vertices: Mapping[str, str] = {}, shared_edges: Mapping[str, str] = {}, guard: str | None = None) -> Condition:  # noqa: N802
    return Condition(pattern, False, shared_vertices, shared_edges, guard)


class _Side:
    """One table prepared for joining: constrained, renamed, with its bindings."""

    def __init__(self, df: DataFrame, binds: dict[str, str]):
        self.df, self.binds = df, binds


def _constrain(df: DataFrame, key: str, attrs: Mapping[str, Any], attr_names: Sequence[str]) -> _Side:
    types = dict(df.dtypes)
    binds: dict[str, str] = {}
    extra: dict[str, Column] = {}
    for name, term in attrs.items():
        if name not in types:
            return _Side(df.filter(F.lit(False)), {})
        col = F.col(name)
        if term is ANY:
            df = df.filter(col.isNotNull())
        elif isinstance(term, Var):
            if term.name in binds:
                same = types[name] == types[binds[term.name]]
                df = df.filter(col.eqNullSafe(F.col(binds[term.name])) if same else F.lit(False))
            else:
                binds[term.name] = name
        elif term is None:
            df = df.filter(col.isNull())
        else:
            df = df.filter(col == F.lit(term) if _same_kind(types[name], term) else F.lit(False))
    for var, name in binds.items():
        extra[f"_b_{var}"] = F.col(name)
    df = df.withColumns(extra) if extra else df
    return _Side(df.select(*[c for c in df.columns if c not in attr_names], *[F.col(a).alias(f"{key}__{a}") for a in attr_names]), binds)


def _may_equal(graph: Graph, a: V, b: V) -> bool:
    """Whether two pattern vertices could be one entity (their concrete types overlap)."""
    cat = graph.catalog
    return bool(set(cat.compatible(a.type, a.subtypes)) & set(cat.compatible(b.type, b.subtypes)))


def _edge_side(graph: Graph, e: E, specs: Mapping[str, V]) -> _Side:
    """Edge rows with one column ``_x_<vertex key>`` per endpoint key of the pattern."""
    et = graph.catalog.edge_types[e.type]
    df = graph.edge_tables[e.type]
    ports = {p.column for p in et.ports}
    attr_names = [c for c in df.columns if c not in ports and c != "edge_id"]
    side = _constrain(df, e.key, e.attrs, attr_names)
    df = side.df
    wanted = {(s, r): ks for s, r, ks in e.slots()}
    for s, r in wanted:
        if et.port(s, r) is None:
            return _Side(df.filter(F.lit(False)).withColumns({f"_x_{k}": F.lit(None).cast("string") for k in e.endpoints()}), side.binds)
    have: set[str] = set()

    def put(df: DataFrame, key: str, value: Column) -> DataFrame:
        if key in have:
            return df.filter(F.col(f"_x_{key}") == value)
        have.add(key)
        return df.withColumn(f"_x_{key}", value)

    unordered = []
    for p in et.ports:
        keys = wanted.get((p.side, p.role), ())
        col = F.col(p.column)
        if p.scalar:
            if not keys:
                df = df.filter(col.isNull())
            elif len(keys) > 1:
                df = df.filter(F.lit(False))
                for k in keys:
                    df = put(df, k, col)
            else:
                df = put(df.filter(col.isNotNull()), keys[0], col)
        elif not keys:
            df = df.filter(col.isNull() | (F.size(col) == 0))
        else:
            df = df.filter(F.size(col) == len(keys))
            if p.ordered:
                for i, k in enumerate(keys):
                    df = put(df, k, col[i])
            else:
                unordered.append((p, keys))
    for p, keys in unordered:
        col = F.col(p.column)
        for k in dict.fromkeys(keys):
            times = keys.count(k)
            if k not in have:
                have.add(k)
                df = df.withColumn(f"_x_{k}", F.explode(F.array_distinct(col)))
            df = df.filter(F.size(F.filter(col, _equals(f"_x_{k}"))) == times)
            for other in dict.fromkeys(keys):
                if other != k and other in have:
                    df = df.filter(F.col(f"_x_{k}") != F.col(f"_x_{other}"))
    for a, b in combinations(sorted(have), 2):
        if _may_equal(graph, specs[a], specs[b]):
            df = df.filter(F.col(f"_x_{a}") != F.col(f"_x_{b}"))
    return _Side(df.drop(*ports).withColumnRenamed("edge_id", f"e_{e.key}"), side.binds)


def _equals(name: str):
    return lambda v: v == F.col(name)


def _vertex_side(graph: Graph, v: V, keep: bool) -> _Side:
    df = graph.of_type(v.type, v.subtypes).drop("type_id")
    attr_names = [c for c in df.columns if c != "vertex_id"]
    side = _constrain(df, v.key, v.attrs, attr_names)
    return _Side(side.df.withColumnRenamed("vertex_id", f"v_{v.key}"), side.binds)


def _proven(graph: Graph, pattern: Pattern, v: V) -> bool:
    """True when some port already guarantees the vertex's type (graph assumed valid)."""
    ok = set(graph.catalog.compatible(v.type, v.subtypes))
    for e in pattern.edges:
        for s, r, keys in e.slots():
            port = graph.catalog.edge_types[e.type].port(s, r)
            if v.key in keys and port is not None:
                if set(graph.catalog.compatible(port.vertex_type, port.allow_subtypes)) <= ok:
                    return True
    return False


def _unify(cur: DataFrame, side: _Side) -> tuple[DataFrame, Column | None, dict[str, Column]]:
    """Join condition for bindings already present, and the new ones to add."""
    types = dict(cur.dtypes)
    other = dict(side.df.dtypes)
    cond: Column | None = None
    fresh = {}
    for var in side.binds:
        mine, theirs = f"b_{var}", f"_b_{var}"
        if mine in types:
            same = F.col(mine).eqNullSafe(F.col(theirs)) if types[mine] == other[theirs] else F.lit(False)
            cond = same if cond is None else cond & same
        else:
            fresh[mine] = F.col(theirs)
    return cur, cond, fresh


def _merge(cur: DataFrame | None, side: _Side, on: Mapping[str, str], allow_cartesian: bool) -> DataFrame:
    """Join one side into the running match; ``on`` maps match columns to side columns."""
    if cur is None:
        out = side.df.withColumns({f"b_{v}": F.col(f"_b_{v}") for v in side.binds}) if side.binds else side.df
        return out.drop(*[f"_b_{v}" for v in side.binds])
    _, cond, fresh = _unify(cur, side)
    right = side.df
    renamed = {b: f"_j_{b}" for b in on.values()}
    for b, j in renamed.items():
        right = right.withColumnRenamed(b, j)
    if on:
        expr = None
        for a, b in on.items():
            hit = F.col(a) == F.col(renamed[b])
            expr = hit if expr is None else expr & hit
        out = cur.join(right, expr, "inner")
    else:
        if not allow_cartesian:
            raise ValueError("the pattern is disconnected: pass allow_cartesian=True for its product semantics")
        # a product by definition, which the caller asked for; how it runs is left to the planner
        out = cur.crossJoin(right)
    if cond is not None:
        out = out.filter(cond)
    if fresh:
        out = out.withColumns(fresh)
    return out.drop(*renamed.values(), *[f"_b_{v}" for v in side.binds])


def _next_in_chain(e: E, left: Sequence[E], have: set[str]) -> E | None:
    """The one edge left at the only unbound end of ``e``, where it leads to unbound vertices only and neither binds variables."""
    fresh = [k for k in e.endpoints() if k not in have]
    if len(e.endpoints()) != 2 or len(fresh) != 1:
        return None
    more = [f for f in left if fresh[0] in f.endpoints()]
    if len(more) != 1 or len(more[0].endpoints()) != 2 or any(k in have for k in more[0].endpoints()) or e.attrs or more[0].attrs:
        return None
    return more[0]


def find(
    graph: Graph, pattern: Pattern, *, anchors: DataFrame | None = None, uses: Sequence[str] = (), keep_attrs: Sequence[str] = (),
    allow_cartesian: bool = False,
) -> DataFrame:
    """All injective typed embeddings: columns ``v_<key>``, ``e_<key>``, ``b_<var>`` and ``<key>__<attr>``.

    ``anchors`` pre-binds any of the ``v_`` / ``e_`` / ``b_`` columns and is joined
    first.  ``uses`` lists expressions evaluated later, so that only the vertices
    they mention are joined for their attributes; ``keep_attrs`` names keys whose
    attributes the caller needs anyway.
    """
    specs = {v.key: v for v in pattern.vertices}
    edges = {e.key: e for e in pattern.edges}
    mentioned = set(keep_attrs)
    for text in uses:
        mentioned |= {n.split("__")[0] for n in ex.names_in(text) if "__" in n}
    cur: DataFrame | None = anchors
    if anchors is not None:
        for c in anchors.columns:
            kind, _, key = c.partition("_")
            if (kind == "v" and key not in specs) or (kind == "e" and key not in edges) or kind not in "veb":
                raise ValueError(f"anchor column {c} names no pattern key")
    bound_v = {c[2:] for c in (anchors.columns if anchors is not None else []) if c.startswith("v_")}
    bound_e = {c[2:] for c in (anchors.columns if anchors is not None else []) if c.startswith("e_")}
    done_v: set[str] = set()
    # edges that hold anchors or close a ring leave few matches, so vertices with nothing but a type or attributes to look up wait for them
    closes = sum(len(e.endpoints()) for e in pattern.edges) >= len(pattern.vertices) + len(pattern.edges)
    late: list[str] = []

    def settle(cur: DataFrame, key: str) -> DataFrame:
        """Check a freshly bound vertex: type, attributes, injectivity."""
        v = specs[key]
        if key not in done_v:
            done_v.add(key)
            proven = _proven(graph, pattern, v)
            if proven and not v.attrs and (key in bound_v or (closes and key in mentioned)):
                late.append(key)
            elif v.attrs or key in mentioned or key in bound_v or not proven:
                cur = _merge(cur, _vertex_side(graph, v, key in mentioned), {f"v_{key}": f"v_{key}"}, allow_cartesian)
            for other in done_v - {key}:
                o = specs[other]
                if _may_equal(graph, v, o):
                    cur = cur.filter(F.col(f"v_{key}") != F.col(f"v_{other}"))
        return cur

    if cur is not None:
        for key in sorted(bound_v):
            cur = settle(cur, key)
    left = list(pattern.edges)
    # literals keep matches few from the start
    limits = any(not isinstance(t, (Var, _Any)) for x in (*pattern.vertices, *pattern.edges) for t in x.attrs.values())
    placed: list[E] = []
    have = set(bound_v)
    while left:
        # most bound endpoints first, then edges with literal constraints, then pattern order
        def rank(e: E) -> tuple:
            bound = sum(k in have for k in e.endpoints()) + (100 if e.key in bound_e else 0)
            lits = sum(not isinstance(t, (Var, _Any)) for t in e.attrs.values())
            lits += sum(len(specs[k].attrs) for k in e.endpoints())
            return (-bound, -lits, pattern.edges.index(e))

        e = min(left, key=rank)
        left.remove(e)
        side = _edge_side(graph, e, specs)
        group = [e]
        if cur is not None and anchors is None and not limits:
            # what hangs on one end is joined before it meets the matches, which then travel once for all of it
            while (f := _next_in_chain(group[-1], left, have)) is not None:
                left.remove(f)
                shared = next(k for k in group[-1].endpoints() if k in f.endpoints())
                side = _Side(_merge(side.df, _edge_side(graph, f, specs), {f"_x_{shared}": f"_x_{shared}"}, False), {})
                group.append(f)
        ends = list(dict.fromkeys(k for g in group for k in g.endpoints()))
        on = {f"v_{k}": f"_x_{k}" for k in ends if k in have and cur is not None}
        if e.key in bound_e:
            on[f"e_{e.key}"] = f"e_{e.key}"
        cur = _merge(cur, side, on, allow_cartesian)
        fresh = [k for k in ends if k not in have]
        for k in fresh:
            cur = cur.withColumnRenamed(f"_x_{k}", f"v_{k}")
            have.add(k)
        for g in group:
            for other in placed:
                if other.type == g.type:
                    cur = cur.filter(F.col(f"e_{g.key}") != F.col(f"e_{other.key}"))
            placed.append(g)
        for k in fresh:
            cur = settle(cur, k)
    for key in late:
        cur = _merge(cur, _vertex_side(graph, specs[key], key in mentioned), {f"v_{key}": f"v_{key}"}, allow_cartesian)
    for v in pattern.vertices:
        if v.key not in have:
            side = _vertex_side(graph, v, v.key in mentioned)
            cur = _merge(cur, side, {}, allow_cartesian)
            have.add(v.key)
            done_v.add(v.key)
            for other in done_v - {v.key}:
                o = specs[other]
                if _may_equal(graph, v, o):
                    cur = cur.filter(F.col(f"v_{v.key}") != F.col(f"v_{other}"))
    return cur


def match_id(pattern: Pattern, rule_id: str = "<pattern>") -> Column:
    """sha256 over the rule and both key maps; equal maps give one id."""
    vs = [F.col(f"v_{v.key}").alias(v.key) for v in sorted(pattern.vertices, key=lambda v: v.key)]
    es = [F.col(f"e_{e.key}").alias(e.key) for e in sorted(pattern.edges, key=lambda e: e.key)]
    parts = [F.lit(rule_id).alias("rule")]
    if vs:
        parts.append(F.struct(*vs).alias("vertices"))
    if es:
        parts.append(F.struct(*es).alias("edges"))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def apply_condition(graph: Graph, base: DataFrame, cond: Condition) -> DataFrame:
    """Semi join (PAC) or anti join (NAC) against the condition's own matches."""
    names = ex.names_in(cond.guard) if cond.guard else set()
    ext = find(graph, cond.pattern, uses=[cond.guard] if cond.guard else [], keep_attrs=())
    base_types, ext_types = dict(base.dtypes), dict(ext.dtypes)
    shared = {f"v_{c}": f"v_{b}" for c, b in cond.shared_vertices.items()}
    shared.update({f"e_{c}": f"e_{b}" for c, b in cond.shared_edges.items()})
    shared.update({c: c for c in ext_types if c.startswith("b_") and c in base_types})
    from_base = [n for n in names if n not in ext_types and n in base_types]
    ctx = [n for n in names if n in ext_types and n not in shared]
    if cond.guard and not from_base:
        ext = ext.filter(ex.checked(cond.guard, ext.columns))
        ctx = []
    cols = [F.col(c).alias(f"_k_{c}") for c in shared] + [F.col(c) for c in ctx]
    # only whether some row fits is asked, so equal rows count once; without any column one row tells
    ext = ext.select(*cols).distinct() if cols else ext.select(F.lit(1).alias("_k_one")).limit(1)
    on = None
    for c, b in shared.items():
        if ext_types[c] != base_types[b]:
            hit = F.lit(False)
        else:
            hit = F.col(b) == F.col(f"_k_{c}") if c[0] in "ve" else F.col(b).eqNullSafe(F.col(f"_k_{c}"))
        on = hit if on is None else on & hit
    if cond.guard and from_base:
        text = cond.guard
        clash = [c for c in ctx if c in base_types]
        for c in clash:
            ext = ext.withColumnRenamed(c, f"_x_{c}")
        pool = [*base.columns, *ctx]
        guard = ex.checked(text, pool)
        on = guard if on is None else on & guard
    return base.join(ext, F.lit(True) if on is None else on, "left_semi" if cond.positive else "left_anti")


def matches(
    graph: Graph, pattern: Pattern, *, conditions: Sequence[Condition] = (), guard: str | None = None, anchors: DataFrame | None = None,
    parameters: Mapping[str, float] | None = None, memory: Mapping[str, float] | None = None, uses: Sequence[str] = (),
    keep_attrs: Sequence[str] = (), rule_id: str | None = None, allow_cartesian: bool = False,
) -> DataFrame:
    """Embeddings that satisfy the guard and every condition."""
    texts = [t for t in (guard, *uses) if t] + [c.guard for c in conditions if c.guard]
    # names a condition's guard takes from its own pattern are resolved there
    df = find(graph, pattern, anchors=anchors, uses=texts, keep_attrs=keep_attrs, allow_cartesian=allow_cartesian)
    df = ex.with_context(df, parameters, memory)
    if guard:
        df = df.filter(ex.checked(guard, df.columns))
    for c in conditions:
        df = apply_condition(graph, df, c)
    if rule_id is not None:
        df = df.withColumn("match_id", match_id(pattern, rule_id))
    return df


def distinct_matches(df: DataFrame) -> DataFrame:
    """One row per match id."""
    return df.dropDuplicates(["match_id"])


def match_delta(before: DataFrame, after: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Classify match ids: added, removed, revalidated (in both and touched) or kept."""
    b = before.select("match_id", F.lit(True).alias("_b"))
    a = after.select("match_id", F.lit(True).alias("_a"))
    both = b.join(a, "match_id", "full_outer")
    if touched is not None:
        both = both.join(touched.select("match_id").distinct().withColumn("_t", F.lit(True)), "match_id", "left")
    else:
        both = both.withColumn("_t", F.lit(True))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_t"), "revalidated").otherwise("kept")
    return both.select("match_id", kind.alias("change"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two match relations that differ, by id and by bindings (multiset)."""
    cols = sorted(set(a.columns) & set(b.columns))
    return one_sided(a.select(*cols), b.select(*cols), "left", "right")


def one_sided(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows with more copies in one table than in the other, once for each copy, and the side; each input is read once."""
    cols = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*cols).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, left).otherwise(right)
    return both.select(*cols, side.alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_n")).drop("_n")


def touched_matches(df: DataFrame, pattern: Pattern, entities: DataFrame) -> DataFrame:
    """Matches that mention an affected entity (``entities``: entity_id)."""
    ids = F.array(*[F.col(f"v_{v.key}") for v in pattern.vertices], *[F.col(f"e_{e.key}") for e in pattern.edges])
    flat = df.select("match_id", F.explode(ids).alias("entity_id"))
    return flat.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").select("match_id").distinct()


def rematch(
    graph_after: Graph, pattern: Pattern, cached: DataFrame, entities: DataFrame, *, conditions: Sequence[Condition] = (), guard: str | None = None,
    parameters: Mapping[str, float] | None = None, rule_id: str = "<pattern>",
) -> DataFrame:
    """Refresh a cached match relation around affected entities only.

    Cached matches that touch nothing affected are kept; new ones are found from
    each affected entity as an anchor of every key it may take.  Rules with
    conditions can change anywhere, so they are matched in full.
    """
    kw = dict(guard=guard, parameters=parameters, rule_id=rule_id)
    if conditions:
        return matches(graph_after, pattern, conditions=conditions, **kw)
    ids = [f"v_{v.key}" for v in pattern.vertices] + [f"e_{e.key}" for e in pattern.edges]
    keep, parts = cached, []
    types = {f"v_{v.key}": v for v in pattern.vertices}
    for c in ids:
        anchors = stale = entities.select(F.col("entity_id").alias(c)).distinct()
        if c in types:
            # entities of other kinds touch and bind nothing; how many are left tells how the matches and the graph are joined
            known = graph_after.of_type(types[c].type, types[c].subtypes).select(F.col("vertex_id").alias(c))
            stale, anchors = cut(stale.join(cached.select(c), c, "left_semi")), cut(anchors.join(known, c, "left_semi"))
        keep = keep.join(stale, c, "left_anti")
        parts.append(matches(graph_after, pattern, anchors=anchors, **kw).select(*ids, "match_id"))
    local = parts[0]
    for p in parts[1:]:
        local = local.unionByName(p)
    return keep.select(*ids, "match_id").unionByName(local.dropDuplicates(["match_id"]))
