"""Rewrite rules as set operations: legal matches, rates, deltas and batches.

A rule has a left pattern and a right template.  Keys on both sides are
preserved, left-only keys are deleted, right-only keys are created.  Rules
produce rows of a delta table; nothing is mutated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..session import cut
from . import match as mt
from .graph import Graph
from .match import Condition, Pattern

DELTA = "event_id STRING, entity_kind STRING, op STRING, entity_id STRING, type_id STRING, before STRING, after STRING"
BOUND_SLACK = 1e-12


@dataclass(frozen=True)
class Ex:
    """SQL text evaluated on the pre-state of a match."""

    text: str


@dataclass(frozen=True)
class NV:
    key: str
    type: str
    attrs: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class NE:
    key: str
    type: str
    tail: Mapping[str, Sequence[str]] = field(default_factory=dict)
    head: Mapping[str, Sequence[str]] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Effect:
    """BIND, REBIND, UNBIND or DELETE_HANDLE of a boundary handle."""

    kind: str
    handle: str
    vertex: str | None = None


@dataclass(frozen=True)
class Output:
    handle: str
    event_type: str
    payload: Mapping[str, Any]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    left: Pattern
    vertices: Sequence[NV]
    edges: Sequence[NE] = ()
    hazard: str = "1.0"
    guard: str | None = None
    conditions: Sequence[Condition] = ()
    parameters: Mapping[str, float] = field(default_factory=dict)
    memory: Mapping[str, float] = field(default_factory=dict)
    effects: Sequence[Effect] = ()
    outputs: Sequence[Output] = ()
    bound: str | None = None
    integral: str | None = None

    def __post_init__(self) -> None:
        if "time" in ex.names_in(self.hazard) and self.bound is None:
            raise ValueError("time-dependent hazards require an upper bound")
        if self.guard and "time" in ex.names_in(self.guard):
            raise ValueError("time-dependent guards are not supported")
        lv = {v.key: v for v in self.left.vertices}
        le = {e.key: e for e in self.left.edges}
        for v in self.vertices:
            if v.key in lv and lv[v.key].type != v.type:
                raise ValueError(f"preserved vertex {v.key} changes type")
        for e in self.edges:
            if e.key in le:
                old = le[e.key]
                if old.type != e.type or _ends(old) != _ends(e):
                    raise ValueError(f"preserved edge {e.key} changes type or incidence")

    def _split(self, left: Sequence, right: Sequence) -> tuple[list[str], list[str], list[str]]:
        a, b = [x.key for x in left], [x.key for x in right]
        return [k for k in a if k in b], [k for k in a if k not in b], [k for k in b if k not in a]

    @property
    def vertex_keys(self):
        """(preserved, deleted, created)"""
        return self._split(self.left.vertices, self.vertices)

    @property
    def edge_keys(self):
        return self._split(self.left.edges, self.edges)


def _ends(e) -> tuple:
    return tuple(sorted((r, tuple(k)) for r, k in e.tail.items())), tuple(sorted((r, tuple(k)) for r, k in e.head.items()))


# --- legality ----------------------------------------------------------------


def dangling(graph: Graph, df: DataFrame, rule: Rule) -> DataFrame:
    """Drop matches that would delete a vertex but leave an edge on it.

    A deleted vertex is legal when every edge on it is deleted by the match.  The
    edges a match deletes on that vertex are known from its columns, so comparing
    their number with the vertex degree decides; no edge list is gathered.
    """
    _, dv, _ = rule.vertex_keys
    _, de, _ = rule.edge_keys
    if not dv:
        return df
    out = df
    left = {e.key: e for e in rule.left.edges}
    kinds = {v.key: v.type for v in rule.left.vertices}
    for k in dv:
        # only edge types with a port this vertex may stand at, and only candidates' edges, are counted
        at = [t for t, et in graph.catalog.edge_types.items() if t in graph.edge_tables and any(_may_meet(graph, p, kinds[k]) for p in et.ports)]
        if not at:
            continue
        candidates = out.select(F.col(f"v_{k}").alias("vertex_id")).distinct()
        degree = graph.incidences(at).join(candidates, "vertex_id", "left_semi").groupBy("vertex_id").agg(F.count_distinct("edge_id").alias("_deg"))
        mine = sum(1 for e in de if k in left[e].endpoints())
        d = degree.withColumnRenamed("vertex_id", f"v_{k}")
        out = out.join(d, f"v_{k}", "left").filter(F.coalesce("_deg", F.lit(0)) <= mine).drop("_deg")
    return out


def _may_meet(graph: Graph, port, kind: str) -> bool:
    """Whether a vertex matched as ``kind`` (or a subtype) can stand at a port."""
    fits = set(graph.catalog.compatible(port.vertex_type, port.allow_subtypes))
    return bool(fits & set(graph.catalog.compatible(kind, True)))


def gluing(df: DataFrame, rule: Rule, handles: DataFrame | None) -> DataFrame:
    """Drop matches that delete a vertex bound by a handle the rule does not mention."""
    _, dv, _ = rule.vertex_keys
    if handles is None or not dv:
        return df
    named = [e.handle for e in rule.effects]
    bound = handles.filter(F.col("binding").isNotNull())
    if named:
        bound = bound.filter(~F.col("handle_id").isin(*named))
    out = df
    for k in dv:
        out = out.join(bound.select(F.col("binding").alias(f"v_{k}")).distinct(), f"v_{k}", "left_anti")
    return out


# --- rates -------------------------------------------------------------------


def hazard_of(df: DataFrame, text: str, policy: str = "error") -> DataFrame:
    """Add ``hazard``; ``hazard_problem`` marks a rate that is not finite or negative.

    ``error`` keeps the marked rows for the caller to fail on, ``disable`` drops
    them, as an occurrence without a valid rate cannot fire.
    """
    h = ex.checked(text, df.columns).cast("double")
    got = df.withColumn("hazard", h)
    bad = F.col("hazard").isNull() | F.isnan("hazard") | (F.abs("hazard") == float("inf")) | (F.col("hazard") < 0)
    if policy == "disable":
        return got.filter(~bad)
    return got.withColumn("hazard_problem", F.when(bad, "invalid_hazard"))


def bound_violations(df: DataFrame, rate: str = "hazard", bound: str = "hazard_bound") -> DataFrame:
    """Rows whose declared upper bound lies below the current rate (1e-12 relative)."""
    r, b = F.col(rate), F.col(bound)
    return df.filter(b.isNull() | (b < r - BOUND_SLACK * F.greatest(F.lit(1.0), F.abs(r))))


def integrated_hazard(df: DataFrame, rule: Rule, start: float, end: float) -> DataFrame:
    """Integral of each rate over [start, end]: analytic text, rate * length, or null."""
    if end < start:
        raise ValueError("the interval is reversed")
    if rule.integral is not None:
        got = df.withColumns({"time": F.lit(float(start)), "horizon": F.lit(float(end))})
        return got.withColumn("integral", ex.checked(rule.integral, got.columns).cast("double")).drop("horizon")
    if "time" in ex.names_in(rule.hazard):
        return df.withColumn("integral", F.lit(None).cast("double"))
    return df.withColumn("integral", F.col("hazard") * F.lit(float(end - start)))


def integrated_activity(df: DataFrame) -> DataFrame:
    """Sum of integrals, null when any of them is unknown."""
    return df.agg(F.when(F.count_if(F.col("integral").isNull()) == 0, F.sum("integral")).alias("integral"), F.count(F.lit(1)).alias("occurrences"))


def occurrences(graph: Graph, rule: Rule, *, handles: DataFrame | None = None, time: float | None = None, anchors: DataFrame | None = None, policy: str = "disable", keep_attrs: Sequence[str] | None = None) -> DataFrame:
    """Legal matches of a rule with their rates; illegal ones never count as enabled."""
    uses = [rule.hazard] + [t for t in (rule.bound, rule.integral) if t] + _texts(rule)
    keep = list(keep_attrs) if keep_attrs is not None else []
    df = mt.matches(
        graph, rule.left, conditions=rule.conditions, guard=rule.guard, anchors=anchors, parameters=rule.parameters, memory=rule.memory,
        uses=uses, keep_attrs=keep, rule_id=rule.rule_id,
    )
    if time is not None:
        df = df.withColumn("time", F.lit(float(time)))
    df = gluing(dangling(graph, df, rule), rule, handles)
    df = hazard_of(df, rule.hazard, policy)
    if rule.bound:
        df = df.withColumn("hazard_bound", ex.checked(rule.bound, df.columns).cast("double"))
    return df.withColumn("rule_id", F.lit(rule.rule_id))


def _texts(rule: Rule) -> list[str]:
    vals = [a for x in [*rule.vertices, *rule.edges] for a in x.attrs.values()] + [p for o in rule.outputs for p in o.payload.values()]
    return [v.text for v in vals if isinstance(v, Ex)]


def occurrence_limits(occ: DataFrame, max_matches: int | None = None, max_activity: float | None = None) -> DataFrame:
    """Matches and activity per rule against hard limits; a breach is an error, never a cut."""
    got = occ.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"), F.sum("hazard").alias("activity"))
    over = lambda c, cap: F.coalesce(F.col(c) > F.lit(cap), F.lit(False))
    return got.withColumn("exceeded", over("matches", max_matches) | over("activity", max_activity))


def canonical_order(matches: DataFrame) -> DataFrame:
    """Range-sorted by match id, for sinks that want the canonical order."""
    return matches.orderBy("match_id")


def all_occurrences(parts: Sequence[DataFrame]) -> DataFrame:
    """Occurrences of several rules: match_id, rule_id, hazard."""
    return reduce(lambda a, b: a.unionByName(b), [p.select("match_id", "rule_id", "hazard") for p in parts])


# --- deltas ------------------------------------------------------------------


def _value(v: Any, columns: Sequence[str], kind: str) -> Column:
    return (ex.checked(v.text, columns) if isinstance(v, Ex) else F.lit(v)).cast(kind)


def _json(cols: Mapping[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(cols.items())])) if cols else F.lit("{}")


def created_id(event: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", event, F.lit(key)), 256)


def delta(graph: Graph, rule: Rule, occ: DataFrame) -> DataFrame:
    """Rows a set of chosen matches adds, changes and removes.

    ``occ`` must carry the attributes of deleted and updated keys (see
    :func:`occurrences` with ``keep_attrs``).  The event id is the match id.  All
    rows of a match come from one ``inline`` of a small array, so there is no join.
    """
    cat = graph.catalog
    ev = F.col("match_id")
    cols = occ.columns
    rows: list[Column] = []

    def row(kind: str, op: str, ident: Column, type_id: str, before: Column | None, after: Column | None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("entity_kind"), F.lit(op).alias("op"), ident.alias("entity_id"), F.lit(type_id).alias("type_id"),
                        (before if before is not None else null).alias("before"), (after if after is not None else null).alias("after"))

    def attrs_of(key: str, names: Sequence[str]) -> dict[str, Column]:
        return {n: F.col(f"{key}__{n}") for n in names if f"{key}__{n}" in cols}

    def ends(e: NE | mt.E, new: set[str]) -> dict[str, Column]:
        def ref(k: str) -> Column:
            return created_id(ev, k) if k in new else F.col(f"v_{k}")

        out = {}
        for side, mapping in (("tail", e.tail), ("head", e.head)):
            for role, keys in mapping.items():
                port = cat.edge_types[e.type].port(side, role)
                out[f"{side}_{role}"] = ref(keys[0]) if port.scalar else F.array(*[ref(k) for k in keys])
        return out

    pv, dv, cv = rule.vertex_keys
    pe, de, ce = rule.edge_keys
    lv, le = {v.key: v for v in rule.left.vertices}, {e.key: e for e in rule.left.edges}
    rv, re_ = {v.key: v for v in rule.vertices}, {e.key: e for e in rule.edges}

    def edge_attr_names(t: str) -> list[str]:
        skip = {p.column for p in cat.edge_types[t].ports} | {"edge_id"}
        return [c for c in graph.edge_tables[t].columns if c not in skip] if t in graph.edge_tables else list(cat.edge_types[t].attrs)

    def vertex_types_of(t: str) -> dict[str, str]:
        return {n: k for n, k in graph.vertex_tables[t].dtypes if n != "vertex_id"} if t in graph.vertex_tables else {}

    for k in sorted(de):
        e = le[k]
        rows.append(row("edge", "delete", F.col(f"e_{k}"), e.type, _json({**attrs_of(k, edge_attr_names(e.type)), **ends(e, set())}), None))
    for k in sorted(dv):
        v = lv[k]
        rows.append(row("vertex", "delete", F.col(f"v_{k}"), v.type, _json(attrs_of(k, list(vertex_types_of(v.type)))), None))
    for k in sorted(cv):
        v = rv[k]
        types = vertex_types_of(v.type)
        rows.append(row("vertex", "create", created_id(ev, k), v.type, None, _json({n: _value(x, cols, types.get(n, "string")) for n, x in v.attrs.items()})))
    for k in sorted(pv):
        if rv[k].attrs:
            types = vertex_types_of(lv[k].type)
            old = attrs_of(k, list(types))
            new = {**old, **{n: _value(x, cols, types[n]) for n, x in rv[k].attrs.items()}}
            rows.append(F.when(~_json(old).eqNullSafe(_json(new)), row("vertex", "update", F.col(f"v_{k}"), lv[k].type, _json(old), _json(new))))
    for k in sorted(ce):
        e = re_[k]
        types = dict(graph.edge_tables[e.type].dtypes) if e.type in graph.edge_tables else {}
        body = {n: _value(x, cols, types.get(n, "double")) for n, x in e.attrs.items()}
        rows.append(row("edge", "create", created_id(ev, k), e.type, None, _json({**body, **ends(e, set(cv))})))
    for k in sorted(pe):
        if re_[k].attrs:
            names = edge_attr_names(le[k].type)
            types = dict(graph.edge_tables[le[k].type].dtypes)
            old = attrs_of(k, names)
            new = {**old, **{n: _value(x, cols, types[n]) for n, x in re_[k].attrs.items()}}
            rows.append(F.when(~_json(old).eqNullSafe(_json(new)), row("edge", "update", F.col(f"e_{k}"), le[k].type, _json(old), _json(new))))
    got = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return occ.select(ev.alias("event_id"), F.inline(got))


def touched_entities(deltas: DataFrame) -> DataFrame:
    """Created, deleted and updated ids."""
    return deltas.select("entity_id").distinct()


def neighbourhood(graph: Graph, deltas: DataFrame) -> DataFrame:
    """Touched ids plus the endpoints of created and deleted edges."""
    parts = [deltas.select("entity_id")]
    body = F.coalesce("after", "before")
    for t, et in graph.catalog.edge_types.items():
        fields = ", ".join(f"{p.column} STRING" if p.scalar else f"{p.column} ARRAY<STRING>" for p in et.ports)
        if not fields:
            continue
        e = deltas.filter((F.col("entity_kind") == "edge") & (F.col("type_id") == t) & F.col("op").isin("create", "delete"))
        parsed = F.from_json(body, fields)
        ids = F.flatten(F.array(*[F.array(parsed[p.column]) if p.scalar else F.coalesce(parsed[p.column], F.array().cast("array<string>")) for p in et.ports]))
        parts.append(e.select(F.explode(ids).alias("entity_id")).filter("entity_id IS NOT NULL"))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def apply_delta(graph: Graph, deltas: DataFrame, vertex_types: Sequence[str], edge_types: Sequence[str]) -> Graph:
    """New graph with the delta applied to the named types; other tables are shared.

    Each touched table is joined once with its latest change per entity, then the
    created rows are appended.
    """
    def one(df: DataFrame, key: str, kind: str, t: str, fixed: Sequence[str] = ()) -> DataFrame:
        d = deltas.filter((F.col("entity_kind") == kind) & (F.col("type_id") == t))
        names = [c for c in df.columns if c != key]
        schema = df.select(*names).schema if names else None
        change = d.filter(F.col("op") != "create").groupBy(F.col("entity_id").alias(key)).agg(
            F.bool_or(F.col("op") == "delete").alias("_gone"), F.max(F.when(F.col("op") == "update", F.col("after"))).alias("_after"))
        j = df.join(change, key, "left").filter(~F.coalesce("_gone", F.lit(False)))
        if schema is None:
            kept = j.select(key)
            made = d.filter("op = 'create'").select(F.col("entity_id").alias(key))
        else:
            new = F.from_json("_after", schema)
            kept = j.select(key, *[(F.coalesce(new[n], F.col(n)) if n in fixed else F.when(F.col("_after").isNotNull(), new[n]).otherwise(F.col(n))).alias(n) for n in names])
            made = d.filter("op = 'create'").select(F.col("entity_id").alias(key), F.from_json("after", schema).alias("_n")).select(key, *[F.col("_n")[n].alias(n) for n in names])
        return kept.unionByName(made)

    v = {t: one(df, "vertex_id", "vertex", t) if t in vertex_types else df for t, df in graph.vertex_tables.items()}
    e = dict(graph.edge_tables)
    for t in edge_types:
        if t in e:
            # updates carry attributes only, so endpoints are kept from the row
            ports = [p.column for p in graph.catalog.edge_types[t].ports]
            e[t] = one(e[t], "edge_id", "edge", t, ports)
    return Graph(graph.catalog, v, e)


# --- batches -----------------------------------------------------------------


def access(rule: Rule, occ: DataFrame) -> DataFrame:
    """match_id, entity_id, is_write for everything a match reads or writes."""
    pv, dv, _ = rule.vertex_keys
    pe, de, ce = rule.edge_keys
    rv, re_ = {v.key: v for v in rule.vertices}, {e.key: e for e in rule.edges}
    le = {e.key: e for e in rule.left.edges}
    writes = {f"v_{k}" for k in dv} | {f"e_{k}" for k in de} | {f"v_{k}" for k in pv if rv[k].attrs} | {f"e_{k}" for k in pe if re_[k].attrs}
    # creating or deleting an edge writes its endpoints
    for k in ce:
        e = re_[k]
        writes |= {f"v_{x}" for ks in [*e.tail.values(), *e.head.values()] for x in ks if x in pv}
    for k in de:
        writes |= {f"v_{x}" for x in le[k].endpoints()}
    ids = [f"v_{v.key}" for v in rule.left.vertices] + [f"e_{e.key}" for e in rule.left.edges]
    items = F.array(*[F.struct(F.col(c).alias("entity_id"), F.lit(c in writes).alias("is_write")) for c in ids])
    return occ.select("match_id", F.inline(items)).groupBy("match_id", "entity_id").agg(F.bool_or("is_write").alias("is_write"))


def first_winners(touch: DataFrame) -> DataFrame:
    """Ids of matches that are the smallest on every entity they share with a writer."""
    best = touch.groupBy("entity_id").agg(F.min("match_id").alias("_min"), F.bool_or("is_write").alias("_w")).filter("_w")
    lost = touch.join(best, "entity_id").filter("match_id <> _min").select("match_id").distinct()
    return touch.join(lost, "match_id", "left_anti").select("match_id").distinct()


def conflict_free_batch(touch: DataFrame) -> DataFrame:
    """Ids of matches that can fire together, lowest id first.

    No chosen match writes an entity another chosen match reads or writes.  Each
    round a match wins if it has the smallest id on every contested entity;
    winners and everything that conflicts with them leave.  The fixpoint equals
    choosing in id order.  A hot entity costs one row per match: its minimum is
    combined on the map side and joins back as a single row.  An entity that no
    open match writes is never contested again, so its rows leave at once.
    """
    open_ = cut(touch.filter("match_id IS NOT NULL").select("match_id", "entity_id", F.coalesce("is_write", F.lit(False)).alias("is_write")))
    parts: list[DataFrame] = []
    while True:
        # of the smallest match's rows one that writes comes first
        first = F.min(F.struct("match_id", (~F.col("is_write")).alias("reads")))
        best = open_.groupBy("entity_id").agg(first.alias("_f"), F.bool_or("is_write").alias("_w")).filter("_w")
        seen = cut(open_.join(best, "entity_id", "left").select("match_id", "entity_id", "is_write", F.col("_f.match_id").alias("_min"), (~F.col("_f.reads")).alias("_minw")))
        won = cut(seen.groupBy("match_id").agg(F.bool_or(F.coalesce(F.col("match_id") != F.col("_min"), F.lit(False))).alias("_lost")).filter("NOT _lost").select("match_id"))
        # every part is a file already; now and then they are merged into one
        parts = [cut(reduce(lambda a, b: a.unionByName(b), parts)), won] if len(parts) >= 16 else [*parts, won]
        # on a contested entity nobody but the smallest match can have won
        late = seen.filter("match_id <> _min")
        clash = late.filter("is_write OR _minw").join(won.select(F.col("match_id").alias("_min")), "_min", "left_semi").select("match_id")
        gone = won.unionByName(clash.distinct())
        open_ = cut(seen.filter("_min IS NOT NULL").select("match_id", "entity_id", "is_write").join(gone, "match_id", "left_anti"))
        if open_.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), parts)


def _prefixes(cond: Condition) -> list[Pattern]:
    """The condition's pattern grown edge by edge from what it shares, without attributes."""
    v = {x.key: x for x in cond.pattern.vertices}
    e = {x.key: x for x in cond.pattern.edges}
    bound = set(cond.shared_vertices) | {k for x in cond.shared_edges for k in e[x].endpoints()}
    done, out = [k for k in cond.shared_edges], []
    while len(done) < len(e):
        near = [k for k in e if k not in done and bound & set(e[k].endpoints())]
        if not near:
            raise ValueError("a condition of a batch must hang together with what it shares with its rule")
        done.append(near[0])
        bound |= set(e[near[0]].endpoints())
        edges = [mt.E(k, e[k].type, e[k].tail, e[k].head) for k in done]
        ends = list(dict.fromkeys(x for x in edges for x in x.endpoints()))
        out.append(Pattern([mt.V(k, v[k].type, subtypes=v[k].subtypes) for k in dict.fromkeys([*ends, *cond.shared_vertices])], edges))
    if bound < set(v):
        raise ValueError("a condition of a batch must hang together with what it shares with its rule")
    return out


def _noticed(graph: Graph, rule: Rule) -> list[str]:
    """The columns of a match whose entities it changes in a way that its rule's conditions could notice.

    Whatever comes or goes with its endpoints, and what gets attributes that a condition asks for.
    """
    (_, dv, _), (_, de, ce) = rule.vertex_keys, rule.edge_keys
    left, right = {e.key: e for e in rule.left.edges}, {e.key: e for e in rule.edges}
    keys = {v.key: v for v in rule.left.vertices}
    out = {f"v_{k}" for k in dv} | {f"e_{k}" for k in de}
    out |= {f"v_{x}" for k in de for x in left[k].endpoints()}
    out |= {f"v_{x}" for k in ce for ks in [*right[k].tail.values(), *right[k].head.values()] for x in ks if x in keys}
    for c in rule.conditions:
        names = ex.names_in(c.guard) if c.guard else set()
        asked = lambda x: set(x.attrs) | {n.removeprefix(f"{x.key}__") for n in names if n.startswith(f"{x.key}__")}  # noqa: B023, E731
        for v in rule.vertices:
            if v.key in keys and any(mt._may_equal(graph, keys[v.key], x) and asked(x) & set(v.attrs) for x in c.pattern.vertices):
                out.add(f"v_{v.key}")
        for e in rule.edges:
            if e.key in left and any(x.type == e.type and asked(x) & set(e.attrs) for x in c.pattern.edges):
                out.add(f"e_{e.key}")
    return sorted(out)


def _seen_by(graph: Graph, open_: DataFrame, cond: Condition, patterns: Sequence[Pattern]) -> DataFrame:
    """match_id, entity_id: what matches of these patterns hold around each open match."""
    parts = []
    for p in patterns:
        ext = mt.find(graph, p)
        keys = {f"v_{c}": f"v_{b}" for c, b in cond.shared_vertices.items()} | {f"e_{c}": f"e_{b}" for c, b in cond.shared_edges.items() if f"e_{c}" in ext.columns}
        on = None
        for c, b in keys.items():
            hit = F.col(f"_s_{c}") == F.col(b)
            on = hit if on is None else on & hit
        ids = [c for c in ext.columns if c[:2] in ("v_", "e_")]
        around = ext.select(*[F.col(c).alias(f"_s_{c}") for c in ids])
        base = open_.select("match_id", *dict.fromkeys(keys.values()))
        parts.append(base.join(around, on).select("match_id", F.explode(F.array(*[F.col(f"_s_{c}") for c in ids])).alias("entity_id")))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def conditional_batch(graph: Graph, rule: Rule, occ: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, delta) after a conflict-free batch of a rule with conditions, as firing one match at a time in id order.

    A match fires if nothing it writes is read or written by a match that fired, nothing it reads is written by one, and
    its conditions hold on the graph that those left behind.  What the extension of a positive condition binds at the
    start counts as read.

    Rounds are semi-naive: each keeps only the matches still open.  A match waits while one with a smaller id writes what
    its conditions look at (everything that the conditions' patterns reach, edge by edge and whatever the attributes), or
    looks at what it writes itself; so all that fire in a round find what they would find one at a time.  Then their delta
    is applied, what conflicts with them leaves, and the conditions of the rest are asked again on the new graph.
    """
    around = [(c, _prefixes(c)) for c in rule.conditions]
    shown = _noticed(graph, rule)
    own = access(rule, occ)
    for c in rule.conditions:
        if c.positive:
            bound = _seen_by(graph, occ, c, [c.pattern]).withColumn("is_write", F.lit(False))
            own = own.unionByName(bound.select(*own.columns))
    own = cut(own.groupBy("match_id", "entity_id").agg(F.bool_or("is_write").alias("is_write")))
    open_, deltas = cut(occ), []
    types = sorted({v.type for v in rule.left.vertices} | {v.type for v in rule.vertices})
    etypes = sorted({e.type for e in rule.left.edges} | {e.type for e in rule.edges})
    while True:
        mine = own.join(open_.select("match_id"), "match_id", "left_semi")
        looks = []
        if shown:
            # where nothing changes that a condition could notice, nobody has to wait
            changing = open_.select(F.explode(F.array(*[F.col(c) for c in shown])).alias("entity_id")).distinct()
            looks = [_seen_by(graph, open_, c, ps).join(changing, "entity_id", "left_semi").withColumn("is_write", F.lit(False)) for c, ps in around if ps]
        touch = reduce(lambda a, b: a.unionByName(b.select(*a.columns)), looks, mine)
        touch = cut(touch.groupBy("match_id", "entity_id").agg(F.bool_or("is_write").alias("is_write")))
        won = cut(first_winners(touch))
        deltas.append(cut(delta(graph, rule, open_.join(won, "match_id", "left_semi"))))
        graph = apply_delta(graph, deltas[-1], types, etypes)
        # tables that changed are files, so plans do not grow with the rounds
        graph = Graph(graph.catalog, {t: cut(d) if t in types else d for t, d in graph.vertex_tables.items()}, {t: cut(d) if t in etypes else d for t, d in graph.edge_tables.items()})
        fired = own.join(won, "match_id", "left_semi").groupBy("entity_id").agg(F.bool_or("is_write").alias("_ww"))
        rest = open_.join(won, "match_id", "left_anti")
        clash = own.join(rest.select("match_id"), "match_id", "left_semi").join(fired, "entity_id").filter("is_write or _ww").select("match_id").distinct()
        open_ = cut(rest.join(clash, "match_id", "left_anti"))
        if not open_.isEmpty():
            for c in rule.conditions:
                open_ = mt.apply_condition(graph, open_, c)
            open_ = cut(open_)
        if open_.isEmpty():
            return graph, reduce(lambda a, b: a.unionByName(b), deltas)


def apply_batch(graph: Graph, rule: Rule, *, handles: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """Occurrences, conflict-free choice, delta and the resulting graph of one epoch; conditions are asked again as matches fire."""
    keep = [v.key for v in rule.left.vertices] + [e.key for e in rule.left.edges]
    occ = cut(occurrences(graph, rule, handles=handles, keep_attrs=keep))
    if rule.conditions:
        return conditional_batch(graph, rule, occ)
    chosen = conflict_free_batch(access(rule, occ))
    d = cut(delta(graph, rule, occ.join(chosen, "match_id", "left_semi")))
    types = {v.type for v in rule.left.vertices} | {v.type for v in rule.vertices}
    etypes = {e.type for e in rule.left.edges} | {e.type for e in rule.edges}
    return apply_delta(graph, d, sorted(types), sorted(etypes)), d


# --- boundary ----------------------------------------------------------------


def boundary_effects(handles: DataFrame, effects: DataFrame) -> DataFrame:
    """Outcome of effects on handles: handle_id, before, after, deleted, problem.

    ``handles``: handle_id, binding, nullable, interface; ``effects``: handle_id,
    kind, vertex_id.
    """
    j = effects.join(handles, "handle_id", "left")
    k = F.col("kind")
    problem = (
        F.when(F.col("nullable").isNull(), "unknown_handle").when((k == "unbind") & ~F.col("nullable"), "not_nullable")
        .when((k == "bind") & F.col("binding").isNotNull(), "already_bound").when(k.isin("bind", "rebind") & F.col("vertex_id").isNull(), "missing_vertex")
    )
    after = F.when(k.isin("bind", "rebind"), F.col("vertex_id")).when(k.isin("unbind", "delete_handle"), None).otherwise(F.col("binding"))
    return j.select("handle_id", "kind", F.col("binding").alias("before"), after.alias("after"), (k == "delete_handle").alias("deleted"), problem.alias("problem"))


def outputs(occ: DataFrame, rule: Rule, directions: Mapping[str, str]) -> DataFrame:
    """One row per match and output spec with its payload as JSON."""
    rows = []
    for i, o in enumerate(rule.outputs):
        if directions.get(o.handle) not in ("output", "bidirectional"):
            raise ValueError(f"handle {o.handle} takes no output")
        body = _json({n: ex.checked(v.text, occ.columns) if isinstance(v, Ex) else F.lit(v) for n, v in o.payload.items()})
        ident = F.sha2(F.concat_ws("|", F.col("match_id"), F.lit(i), F.lit(o.handle)), 256)
        rows.append(F.struct(ident.alias("output_id"), F.lit(i).alias("position"), F.lit(o.handle).alias("handle_id"), F.lit(o.event_type).alias("event_type"), body.alias("payload")))
    return occ.select(F.col("match_id").alias("event_id"), F.inline(F.array(*rows)))


def rule_instances(matches: DataFrame, bindings: DataFrame, specs: Mapping[str, Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """(instances, rejected): a template's matches under every valid binding row.

    ``bindings``: instance_id and one column per parameter; ``specs`` maps each to
    its lower / upper / choices.  Every match meets every binding, so matches are
    dealt over salts and each salt gets the bindings: no row meets all others in
    one task, and the planner still broadcasts a small table of bindings.
    """
    checks = []
    for name, s in specs.items():
        c = F.col(name)
        if s.get("required", True):
            checks.append(F.when(c.isNull(), F.lit(f"{name} is missing")))
        if s.get("lower") is not None:
            checks.append(F.when(c < s["lower"], F.lit(f"{name} is below its lower bound")))
        if s.get("upper") is not None:
            checks.append(F.when(c > s["upper"], F.lit(f"{name} is above its upper bound")))
        if s.get("choices") is not None:
            checks.append(F.when(~c.isin(*s["choices"]), F.lit(f"{name} is not a choice")))
    judged = bindings.withColumn("problem", F.get(F.filter(F.array(*checks), lambda x: x.isNotNull()), F.lit(0)) if checks else F.lit(None).cast("string"))
    good = judged.filter("problem IS NULL").select("instance_id", *specs)
    salts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = matches.withColumn("_salt", F.pmod(F.xxhash64(*matches.columns), F.lit(salts)).cast("int"))
    each = good.select("instance_id", *[F.col(s).alias(f"meta_{s}") for s in specs]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    inst = dealt.join(each, "_salt").select(*matches.columns, "instance_id", *[f"meta_{s}" for s in specs])
    return inst, judged.filter("problem IS NOT NULL").select("instance_id", "problem")


def routing_scores(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Exp-linear routing utility per policy: throughput, qos, semantic.

    Needs service_rate, link_quality, load, capacity, energy_cost, reliability,
    fidelity, utility, deadline.
    """
    w = {k: F.lit(float(v)) for k, v in weights.items()}
    c = F.col
    base = (
        w["speed_weight"] * (c("service_rate") / w["service_scale"]) + w["link_weight"] * c("link_quality")
        - w["load_weight"] * (c("load") / c("capacity")) - w["energy_weight"] * c("energy_cost")
    )
    qos = base + w["qos_reliability_weight"] * c("reliability") + w["qos_fidelity_weight"] * c("fidelity")
    semantic = qos + w["semantic_weight"] * (c("utility") / c("deadline")) * c("reliability") * c("fidelity")
    score = lambda x: w["route_rate"] * F.exp(w["choice_beta"] * x)
    return df.withColumns({"throughput_score": score(base), "qos_score": score(qos), "semantic_score": score(semantic)})


def payload_violations(raw: DataFrame, specs: Mapping[str, Any], extensions: bool = False, column: str = "payload", key: str = "id") -> DataFrame:
    """Boundary payloads that break their handle's field rules (JSON object text)."""
    m = F.from_json(F.col(column), "map<string,string>")
    v = F.try_parse_json(F.col(column))
    kinds = {"int": ["BIGINT"], "bool": ["BOOLEAN"], "string": ["STRING"], "float": ["BIGINT", "DOUBLE"]}
    checks = [F.when(m.isNull(), F.struct(F.lit("not_an_object").alias("code"), F.lit("").alias("detail")))]
    present = F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    for name, a in specs.items():
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        has = F.array_contains(present, name)
        num = F.try_variant_get(v, f"$.{name}", "double")
        hit = lambda cond, code, n=name: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(n).alias("detail")))
        if a.required:
            checks.append(hit(m.isNotNull() & ~has, "missing_required"))
        if a.kind in kinds:
            ok = kind.isin(*kinds[a.kind]) | (kind.startswith("DECIMAL") if a.kind == "float" else F.lit(False))
            checks.append(hit(has & ~F.coalesce(ok, F.lit(False)), "wrong_kind"))
        if a.minimum is not None:
            checks.append(hit(num < a.minimum, "below_minimum"))
        if a.maximum is not None:
            checks.append(hit(num > a.maximum, "above_maximum"))
    if specs and not extensions:
        unknown = F.array_sort(F.array_except(present, F.array(*[F.lit(n) for n in specs])))
        checks.append(F.when(F.size(unknown) > 0, F.struct(F.lit("unknown_field").alias("code"), F.array_join(unknown, ",").alias("detail"))))
    return raw.select(key, F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))
