"""Typed hypergraphs as DataFrames: catalogue, tables, validation, features of vertices.

A graph holds one typed table per vertex type and per edge type.  An edge table
carries its endpoints in columns ``<side>_<role>``: a STRING when the port takes
at most one vertex, else an ARRAY<STRING> in ordinal order.  So a pattern edge
costs one scan and no self-join of an incidence table; :func:`incidences` gives
the long form where it is wanted.
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

# rows of offending vertices that are broadcast
_FEW = 50_000

INCIDENCE = ("edge_id", "edge_type", "side", "role", "ordinal", "vertex_id")


@dataclass(frozen=True)
class Attr:
    """Attribute rule: kind is bool, int, float, string, entity_ref or any."""

    kind: str = "any"
    required: bool = False
    default: Any = None
    mutable: bool = True
    nullable: bool = False
    minimum: float | None = None
    maximum: float | None = None
    choices: tuple | None = None


@dataclass(frozen=True)
class VertexType:
    name: str
    parents: tuple[str, ...] = ()
    attrs: Mapping[str, Attr] = field(default_factory=dict)
    extensions: bool = False
    invariants: tuple[str, ...] = ()


@dataclass(frozen=True)
class Port:
    side: str
    role: str
    vertex_type: str
    minimum: int = 1
    maximum: int | None = 1
    ordered: bool = True
    allow_subtypes: bool = True
    repeated: bool = False

    @property
    def column(self) -> str:
        return f"{self.side}_{self.role}"

    @property
    def scalar(self) -> bool:
        return self.maximum == 1


@dataclass(frozen=True)
class EdgeType:
    name: str
    ports: tuple[Port, ...] = ()
    attrs: Mapping[str, Attr] = field(default_factory=dict)
    extensions: bool = False
    invariants: tuple[str, ...] = ()

    def port(self, side: str, role: str) -> Port | None:
        return next((p for p in self.ports if p.side == side and p.role == role), None)


class Catalog:
    """The declared types.  A catalogue is written by hand, so it lives on the driver."""

    def __init__(self, vertex_types: Sequence[VertexType], edge_types: Sequence[EdgeType]):
        self.vertex_types = {t.name: t for t in vertex_types}
        self.edge_types = {t.name: t for t in edge_types}
        if len(self.vertex_types) != len(vertex_types) or len(self.edge_types) != len(edge_types):
            raise ValueError("duplicate type name")
        for t in vertex_types:
            unknown = set(t.parents) - set(self.vertex_types)
            if unknown:
                raise ValueError(f"{t.name}: unknown parent types {sorted(unknown)}")
        for t in edge_types:
            for p in t.ports:
                if p.vertex_type not in self.vertex_types:
                    raise ValueError(f"{t.name}.{p.role}: unknown vertex type {p.vertex_type}")
        self._up: dict[str, frozenset[str]] = {}
        for name in self.vertex_types:
            self._close(name, ())

    def _close(self, name: str, path: tuple[str, ...]) -> frozenset[str]:
        if name in path:
            raise ValueError(f"subtype cycle through {name}")
        if name not in self._up:
            up = {name}
            for parent in self.vertex_types[name].parents:
                up |= self._close(parent, (*path, name))
            self._up[name] = frozenset(up)
        return self._up[name]

    def ancestors(self, name: str) -> frozenset[str]:
        return self._up[name]

    def compatible(self, expected: str, allow_subtypes: bool = True) -> list[str]:
        """Concrete types an entity may have where ``expected`` is asked for."""
        if not allow_subtypes:
            return [expected]
        return sorted(t for t, up in self._up.items() if expected in up)

    def closure_df(self, spark) -> DataFrame:
        rows = [(t, a) for t, up in sorted(self._up.items()) for a in sorted(up)]
        return spark.createDataFrame(rows, "type_id STRING, ancestor STRING")

    def ports_df(self, spark) -> DataFrame:
        rows = [
            (t.name, p.side, p.role, p.vertex_type, p.minimum, p.maximum, p.ordered, p.allow_subtypes, p.repeated)
            for t in self.edge_types.values() for p in t.ports
        ]
        return spark.createDataFrame(
            rows, "edge_type STRING, side STRING, role STRING, vertex_type STRING, minimum INT, maximum INT, ordered BOOLEAN, allow_subtypes BOOLEAN, repeated BOOLEAN"
        )


def subtype_closure(edges: DataFrame, child: str = "type_id", parent: str = "parent") -> DataFrame:
    """Reflexive-transitive closure of a type table that is itself data.

    Path doubling: ``step`` holds the walks of exactly 2^k edges and each round appends
    them to all shorter ones.  So a chain of any depth takes a logarithmic number of
    rounds, each pair of a chain is made once, and a cycle ends as soon as it adds nothing.
    """
    e = edges.select(F.col(child).alias("type_id"), F.col(parent).alias("ancestor")).filter("type_id IS NOT NULL AND ancestor IS NOT NULL")
    names = edges.select(F.col(child).alias("t")).union(edges.select(parent)).filter("t IS NOT NULL").distinct()
    up = cut(names.select(F.col("t").alias("type_id"), F.col("t").alias("ancestor")))
    step = cut(e.filter("type_id <> ancestor").distinct())
    size = up.count()
    while not step.isEmpty():
        further = step.select(F.col("type_id").alias("ancestor"), F.col("ancestor").alias("_further"))
        add = lambda d: d.join(further, "ancestor").select("type_id", F.col("_further").alias("ancestor"))
        up = cut(up.unionByName(add(up)).distinct())
        grown = up.count()
        if grown == size:
            break
        size, step = grown, cut(add(step).distinct())
    return up


def subtype_cycles(closure: DataFrame) -> DataFrame:
    """Types that are among their own proper ancestors: type_id and the other type on the cycle."""
    back = closure.select(F.col("ancestor").alias("type_id"), F.col("type_id").alias("ancestor"))
    return closure.filter("type_id <> ancestor").join(back, ["type_id", "ancestor"], "left_semi")


class Graph:
    """Vertex and edge tables under a catalogue; every method returns a DataFrame."""

    def __init__(self, catalog: Catalog, vertices: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]):
        self.catalog = catalog
        self.vertex_tables = dict(vertices)
        self.edge_tables = dict(edges)

    # --- views ---
    def vertices(self) -> DataFrame:
        return _union([d.select("vertex_id", F.lit(t).alias("type_id")) for t, d in self.vertex_tables.items()])

    def edges(self) -> DataFrame:
        return _union([d.select("edge_id", F.lit(t).alias("type_id")) for t, d in self.edge_tables.items()])

    def incidences(self, types: Sequence[str] | None = None) -> DataFrame:
        """Long form: one row per endpoint slot."""
        parts = []
        for t, d in self.edge_tables.items():
            if types is not None and t not in types:
                continue
            slots = []
            for p in self.catalog.edge_types[t].ports:
                if p.scalar:
                    cell = F.array(F.struct(F.lit(p.side).alias("side"), F.lit(p.role).alias("role"), F.lit(0).alias("ordinal"), F.col(p.column).alias("vertex_id")))
                    slots.append(F.when(F.col(p.column).isNotNull(), cell).otherwise(F.slice(cell, 1, 0)))
                else:
                    slots.append(F.transform(F.coalesce(F.col(p.column), F.array().cast("array<string>")), _slot(p)))
            if slots:
                parts.append(d.select("edge_id", F.lit(t).alias("edge_type"), F.inline(F.concat(*slots))))
        return _union(parts).select(*INCIDENCE)

    def of_type(self, expected: str, allow_subtypes: bool = True, columns: Sequence[str] = ()) -> DataFrame:
        """Vertices compatible with a type; attributes missing from a subtype are null."""
        names = [t for t in self.catalog.compatible(expected, allow_subtypes) if t in self.vertex_tables]
        if not names:
            raise KeyError(f"no table for type {expected}")
        parts = [self.vertex_tables[t].withColumn("type_id", F.lit(t)) for t in names]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def degree(self) -> DataFrame:
        """Distinct incident edges per vertex (0 for isolated ones).

        Ends of an edge whose id is its own are counted where they stand; only edges
        that share an id, or have none, are compared.
        """
        rows = [(d, [F.array(p.column) if p.scalar else F.coalesce(F.col(p.column), F.array().cast("array<string>")) for p in self.catalog.edge_types[t].ports]) for t, d in self.edge_tables.items()]
        ends = _union([d.select("edge_id", F.array_distinct(F.concat(*cells)).alias("_ends")) for d, cells in rows if cells])
        shared = cut(self.edges().groupBy("edge_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR edge_id IS NULL").select(F.col("edge_id").alias("_shared")))
        same = F.col("edge_id").eqNullSafe(F.col("_shared"))
        once = ends.join(shared, same, "left_anti").select(F.explode("_ends").alias("vertex_id"))
        again = ends.join(shared, same, "left_semi").select("edge_id", F.explode("_ends").alias("vertex_id")).distinct().select("vertex_id")
        per = once.unionByName(again).groupBy("vertex_id").agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices().join(per, "vertex_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def slot_counts(self) -> DataFrame:
        """Rows (n), distinct edges and distinct vertices of every slot of the long form.

        The slots of an edge are counted in one group, where the map side meets them, so
        an edge id is shuffled once for all its slots; vertices are made distinct apart.
        """
        slot, parts = ["edge_type", "side", "role"], []
        for t in self.edge_tables:
            ports = self.catalog.edge_types[t].ports
            if ports:
                per = self.incidences([t]).groupBy("edge_id").agg(*[F.count_if((F.col("side") == p.side) & (F.col("role") == p.role)).alias(f"_n{i}") for i, p in enumerate(ports)])
                whole = per.agg(*[c for i in range(len(ports)) for c in (F.sum(f"_n{i}").alias(f"_n{i}"), F.count_if((F.col(f"_n{i}") > 0) & F.col("edge_id").isNotNull()).alias(f"_e{i}"))])
                cells = [F.struct(F.lit(t).alias("edge_type"), F.lit(p.side).alias("side"), F.lit(p.role).alias("role"), F.col(f"_n{i}").alias("n"), F.col(f"_e{i}").alias("edges")) for i, p in enumerate(ports)]
                parts.append(whole.select(F.inline(F.array(*cells))).filter("n > 0"))
        vertices = self.incidences().select(*slot, "vertex_id").distinct().groupBy(*slot).agg(F.count("vertex_id").alias("vertices"))
        return _union(parts).join(vertices, slot).select(*slot, "n", "edges", "vertices")

    def incident_edges(self) -> DataFrame:
        return self.incidences().select("vertex_id", "edge_id", "edge_type").distinct()


def _slot(p: Port):
    return lambda v, i: F.struct(F.lit(p.side).alias("side"), F.lit(p.role).alias("role"), i.alias("ordinal"), v.alias("vertex_id"))


def from_tables(catalog: Catalog, vertices: Mapping[str, DataFrame], edges: Mapping[str, DataFrame], incidences: DataFrame) -> Graph:
    """Build a graph from long-form incidences (edge_id, side, role, ordinal, vertex_id)."""
    tables = {}
    for name, df in edges.items():
        aggs = []
        for p in catalog.edge_types[name].ports:
            slot = (F.col("side") == p.side) & (F.col("role") == p.role)
            if p.scalar:
                aggs.append(F.max(F.when(slot, F.col("vertex_id"))).alias(p.column))
            else:
                # one edge's own endpoints, in ordinal order
                got = F.array_sort(F.collect_list(F.when(slot, F.struct("ordinal", "vertex_id"))))
                aggs.append(F.transform(got, lambda x: x["vertex_id"]).alias(p.column))
        if aggs:
            wide = incidences.groupBy("edge_id").agg(*aggs)
            tables[name] = df.join(wide, "edge_id", "left")
        else:
            tables[name] = df
    return Graph(catalog, vertices, tables)


def to_tables(graph: Graph) -> dict[str, DataFrame]:
    """``vertices``, ``edges`` and ``incidences`` with attributes as JSON, for export."""
    def packed(tables: Mapping[str, DataFrame], key: str, skip: Mapping[str, set]) -> DataFrame:
        parts = []
        for t, d in tables.items():
            attrs = sorted(c for c in d.columns if c != key and c not in skip.get(t, set()))
            body = F.to_json(F.struct(*attrs)) if attrs else F.lit("{}")
            parts.append(d.select(key, F.lit(t).alias("type_id"), body.alias("attributes")))
        return _union(parts)

    ports = {t: {p.column for p in e.ports} for t, e in graph.catalog.edge_types.items()}
    return {
        "vertices": packed(graph.vertex_tables, "vertex_id", {}),
        "edges": packed(graph.edge_tables, "edge_id", ports),
        "incidences": graph.incidences(),
    }


def write_graph(graph: Graph, path: str) -> None:
    """Parquet export partitioned by type, so that type filters prune files."""
    for name, df in to_tables(graph).items():
        by = "edge_type" if name == "incidences" else "type_id"
        df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}")


# --- attribute rules ---------------------------------------------------------

_KINDS = {
    "bool": ("boolean",),
    "int": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double", "tinyint", "smallint", "int", "bigint"),
    "string": ("string",),
    "entity_ref": ("string",),
}


def materialize_attributes(df: DataFrame, specs: Mapping[str, Attr]) -> DataFrame:
    """Fill declared defaults; a missing column of a defaulted or nullable attribute is added."""
    out = df
    for name, a in specs.items():
        value = F.lit(a.default)
        if name not in df.columns:
            if a.default is not None or a.nullable:
                out = out.withColumn(name, value)
        elif a.default is not None and not a.nullable:
            out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def attribute_violations(df: DataFrame, key: str, specs: Mapping[str, Attr], extensions: bool = False, reserved: Sequence[str] = (), invariants: Sequence[str] = ()) -> DataFrame:
    """Long report (entity_id, code, detail) of every broken attribute rule."""
    types = dict(df.dtypes)
    checks: list[Column] = []

    def bad(cond: Column, code: str, name: str) -> None:
        checks.append(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(name).alias("detail"))))

    for name, a in specs.items():
        if name not in types:
            if a.required and a.default is None and not a.nullable:
                bad(F.lit(True), "missing_required", name)
            continue
        c, kind = F.col(name), types[name]
        if not a.nullable:
            bad(c.isNull(), "missing_required" if a.required else "not_nullable", name)
        if a.kind in _KINDS and kind not in _KINDS[a.kind]:
            bad(c.isNotNull(), "wrong_kind", name)
            continue
        if kind in ("float", "double"):
            bad(F.isnan(c) | (F.abs(c) == float("inf")), "not_finite", name)
        if a.minimum is not None:
            bad(c < a.minimum, "below_minimum", name)
        if a.maximum is not None:
            bad(c > a.maximum, "above_maximum", name)
        if a.choices is not None:
            same = [v for v in a.choices if _same_kind(kind, v)]
            bad(c.isNotNull() & (~c.isin(*same) if same else F.lit(True)), "not_a_choice", name)
    if not extensions:
        for name in types:
            if name not in specs and name != key and name not in reserved:
                bad(F.col(name).isNotNull(), "unknown_attribute", name)
    for text in invariants:
        bad(~F.coalesce(ex.checked(text, df.columns), F.lit(False)), "invariant", text)
    if not checks:
        return df.select(F.col(key).alias("entity_id"), F.lit("").alias("code"), F.lit("").alias("detail")).limit(0)
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(F.col(key).alias("entity_id"), F.inline(found))


def _same_kind(kind: str, value: Any) -> bool:
    """Typed equality: 1, 1.0 and True are three different values."""
    if isinstance(value, bool):
        return kind == "boolean"
    if isinstance(value, int):
        return kind in ("tinyint", "smallint", "int", "bigint")
    if isinstance(value, float):
        return kind in ("float", "double") or kind.startswith("decimal")
    if isinstance(value, str):
        return kind == "string"
    return False


def immutable_violations(before: DataFrame, after: DataFrame, key: str, specs: Mapping[str, Attr]) -> DataFrame:
    """Entities whose non-mutable attributes differ between two versions of a table."""
    frozen = [n for n, a in specs.items() if not a.mutable]
    b = before.select(key, *[F.col(n).alias(f"_b_{n}") for n in frozen])
    joined = after.select(key, *frozen).join(b, key)
    hits = F.filter(F.array(*[F.when(~F.col(n).eqNullSafe(F.col(f"_b_{n}")), F.lit(n)) for n in frozen]), lambda x: x.isNotNull())
    return joined.select(F.col(key).alias("entity_id"), F.lit("immutable").alias("code"), F.explode(hits).alias("detail"))


def replace_attributes(before: DataFrame, updates: DataFrame, key: str, specs: Mapping[str, Attr]) -> DataFrame:
    """``replace`` update: omitted (null) immutable attributes keep their value, others are cleared."""
    names = [c for c in before.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") if c in updates.columns else F.lit(None).alias(f"_u_{c}") for c in names], F.lit(True).alias("_hit"))
    j = before.join(u, key, "left")

    def pick(c: str) -> Column:
        new = F.col(f"_u_{c}")
        if c in specs and not specs[c].mutable:
            new = F.coalesce(new, F.col(c))
        return F.when(F.col("_hit"), new).otherwise(F.col(c)).alias(c)

    return j.select(key, *[pick(c) for c in names])


def subtype_filter(df: DataFrame, closure: DataFrame, expected: str, allow_subtypes: bool = True, type_col: str = "type_id") -> DataFrame:
    """Rows whose type is ``expected`` or, with subtypes, has it among its ancestors."""
    if not allow_subtypes:
        return df.filter(F.col(type_col) == expected)
    ok = closure.filter(F.col("ancestor") == expected).select(F.col("type_id").alias(type_col))
    return df.join(ok, type_col, "left_semi")


# --- structure ---------------------------------------------------------------


def port_violations(edges: DataFrame, incidences: DataFrame, vertices: DataFrame, ports: DataFrame, closure: DataFrame) -> DataFrame:
    """Cardinality, repeats, unknown roles, missing and incompatible endpoints.

    ``edges`` (edge_id, type_id), ``incidences`` (edge_id, side, role, ordinal,
    vertex_id), ``vertices`` (vertex_id, type_id).  Ports and closure are
    catalogue tables.  An edge is judged by counts per slot, which the map side
    combines; vertices are looked up once per distinct (slot, vertex), and only
    the offending ones go back to the edges.
    """
    rows = ports.collect()
    p = ports.withColumnRenamed("edge_type", "type_id")
    types, slots = sorted({r["edge_type"] for r in rows}), sorted({(r["side"], r["role"]) for r in rows})
    here = lambda slot: (F.col("side") == slot[0]) & (F.col("role") == slot[1])
    listed = reduce(lambda a, b: a | b, [here(s) for s in slots], F.lit(False))
    both = incidences.select("edge_id", "side", "role", F.col("vertex_id").isNotNull().alias("_v"), F.lit(None).cast("string").alias("_t")).unionByName(
        edges.select("edge_id", F.lit(None).cast("string").alias("side"), F.lit(None).cast("string").alias("role"), F.lit(False).alias("_v"), F.col("type_id").alias("_t")))
    per = both.groupBy("edge_id").agg(
        *[F.count_if(F.col("_t") == t).alias(f"_e{i}") for i, t in enumerate(types)], *[F.count_if(here(s)).alias(f"_n{j}") for j, s in enumerate(slots)],
        *[F.count_if(here(s) & F.col("_v")).alias(f"_v{j}") for j, s in enumerate(slots)])
    found = []
    say = lambda code, slot: F.struct(code.alias("code"), F.lit(f"{slot[0]}.{slot[1]}").alias("detail"))
    # a null edge id stands for no edge: its slots are unknown and edges without an id have no endpoints
    known = F.col("edge_id").isNotNull()
    for r in rows:
        slot = r["side"], r["role"]
        j = slots.index(slot)
        n = F.when(known, F.col(f"_n{j}")).otherwise(F.lit(0))
        code = F.when(n < r["minimum"], "below_port_minimum")
        if r["maximum"] is not None:
            code = code.when(n > r["maximum"], "above_port_maximum")
        if not r["repeated"]:
            code = code.when(known & (F.col(f"_v{j}") < F.col(f"_n{j}")), "repeated_vertex")
        found.append(F.when(code.isNotNull(), F.array_repeat(say(code, slot), F.col(f"_e{types.index(r['edge_type'])}").cast("int"))))
    for j, slot in enumerate(slots):
        mine = [F.col(f"_e{types.index(r['edge_type'])}") > 0 for r in rows if (r["side"], r["role"]) == slot]
        found.append(F.when((F.col(f"_n{j}") > 0) & ~(known & reduce(lambda a, b: a | b, mine)), F.array(say(F.lit("unknown_role"), slot))))
    first = per.select(F.col("edge_id").alias("entity_id"), F.inline(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull())))) if found else None
    strange = incidences.filter(~F.coalesce(listed, F.lit(False))).select("edge_id", "side", "role").distinct()
    strange = strange.select(F.col("edge_id").alias("entity_id"), F.lit("unknown_role").alias("code"), F.concat_ws(".", "side", "role").alias("detail"))
    first = strange if first is None else first.unionByName(strange)
    many = [(r["side"], r["role"]) for r in rows if not r["repeated"] and (r["maximum"] is None or r["maximum"] > 1)]
    if many:
        # only slots that may hold several vertices can repeat one
        have = incidences.filter(reduce(lambda a, b: a | b, [here(s) for s in many])).groupBy("edge_id", "side", "role").agg(
            F.count(F.lit(1)).alias("n"), F.count("vertex_id").alias("v"), F.count_distinct("vertex_id").alias("d")).filter("n = v AND n <> d")
        fits = (F.col("n") >= F.col("minimum")) & (F.col("maximum").isNull() | (F.col("n") <= F.col("maximum"))) & ~F.col("repeated")
        twice = have.join(edges, "edge_id").join(F.broadcast(p), ["type_id", "side", "role"]).filter(fits)
        first = first.unionByName(twice.select(F.col("edge_id").alias("entity_id"), F.lit("repeated_vertex").alias("code"), F.concat_ws(".", "side", "role").alias("detail")))
    used = incidences.select("side", "role", "vertex_id").distinct()
    seen = used.join(vertices.select("vertex_id", F.col("type_id").alias("vtype")), "vertex_id", "left")
    ok = closure.select(F.col("type_id").alias("vtype"), "ancestor", F.lit(True).alias("_up"))
    typed = seen.filter("vtype IS NOT NULL").join(F.broadcast(p.select("type_id", "side", "role", F.col("vertex_type").alias("ancestor"), "allow_subtypes")), ["side", "role"])
    typed = typed.join(F.broadcast(ok), ["vtype", "ancestor"], "left")
    fits = (F.col("vtype") == F.col("ancestor")) | (F.col("allow_subtypes") & F.coalesce("_up", F.lit(False)))
    bad = cut(seen.filter("vtype IS NULL").select("side", "role", "vertex_id", F.lit(None).cast("string").alias("_t")).unionByName(
        typed.filter(~fits).select("side", "role", "vertex_id", F.col("type_id").alias("_t"))))
    same = lambda cols: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
    bad = bad.select(*[F.col(c).alias(f"_{c}") for c in ("side", "role", "vertex_id")], "_t")
    hit = incidences.join(bad.select("_side", "_role").distinct(), same(["side", "role"]), "left_semi")
    hit = hit.join(F.broadcast(bad) if bad.count() <= _FEW else bad.hint("merge"), same(["side", "role", "vertex_id"]))
    missing = hit.filter("_t IS NULL").select(F.col("edge_id").alias("entity_id"), F.lit("unknown_vertex").alias("code"), F.col("vertex_id").alias("detail"))
    wrong = hit.filter("_t IS NOT NULL").select("edge_id", F.col("_t").alias("type_id"), "vertex_id").join(edges, ["edge_id", "type_id"])
    wrong = wrong.select(F.col("edge_id").alias("entity_id"), F.lit("incompatible_vertex").alias("code"), F.col("vertex_id").alias("detail"))
    return first.unionByName(missing).unionByName(wrong)


def index_violations(vertices: DataFrame, edges: DataFrame, incidences: DataFrame) -> DataFrame:
    """Ids used twice, ids shared by a vertex and an edge, incidences of absent edges."""
    orphan = incidences.join(edges, "edge_id", "left_anti").select(F.col("edge_id").alias("entity_id"), F.lit("orphan_incidence").alias("code"), F.col("vertex_id").alias("detail"))
    return id_violations(vertices, edges).unionByName(orphan)


def endpoint_violations(graph: Graph) -> DataFrame:
    """Missing or wrongly typed endpoints of the typed edge tables.

    Vertices are looked up once per distinct (port, vertex), which the map side
    combines, and only the offending ones, normally none, go back to the edges.
    """
    cat = graph.catalog
    inc = graph.incidences()
    used = inc.select("edge_type", "side", "role", "vertex_id").distinct()
    seen = used.join(graph.vertices(), "vertex_id", "left")
    fits = F.lit(False)
    for t in graph.edge_tables:
        for p in cat.edge_types[t].ports:
            here = (F.col("edge_type") == t) & (F.col("side") == p.side) & (F.col("role") == p.role)
            fits = F.when(here, F.col("type_id").isin(*cat.compatible(p.vertex_type, p.allow_subtypes))).otherwise(fits)
    code = F.when(F.col("type_id").isNull(), "unknown_vertex").when(~fits, "incompatible_vertex")
    bad = seen.select("edge_type", "side", "role", "vertex_id", code.alias("code")).filter("code IS NOT NULL")
    hit = inc.join(bad, ["edge_type", "side", "role", "vertex_id"])
    return hit.select(F.col("edge_id").alias("entity_id"), "code", F.col("vertex_id").alias("detail"))


def cardinality_violations(df: DataFrame, edge_type: EdgeType) -> DataFrame:
    """Port minimum, maximum and repeats of one typed edge table, row by row."""
    checks = []
    for p in edge_type.ports:
        c = F.col(p.column)
        n = F.when(c.isNotNull(), 1).otherwise(0) if p.scalar else F.coalesce(F.size(c), F.lit(0))
        code = F.when(n < p.minimum, "below_port_minimum")
        if p.maximum is not None and not p.scalar:
            code = code.when(n > p.maximum, "above_port_maximum")
        if not p.repeated and not p.scalar:
            code = code.when(F.size(F.array_distinct(c)) != F.size(c), "repeated_vertex")
        checks.append(F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(f"{p.side}.{p.role}").alias("detail"))))
    return df.select(F.col("edge_id").alias("entity_id"), F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))


def id_violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids used twice or shared by a vertex and an edge."""
    ids = vertices.select(F.col("vertex_id").alias("entity_id"), F.lit(1).alias("v")).unionByName(
        edges.select(F.col("edge_id").alias("entity_id"), F.lit(0).alias("v"))
    )
    per = ids.groupBy("entity_id").agg(F.sum("v").alias("nv"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    code = F.when((F.col("nv") > 0) & (F.col("nv") < F.col("n")), "id_shared").otherwise("id_duplicate")
    return per.select("entity_id", code.alias("code"), F.col("n").cast("string").alias("detail"))


def validate_graph(graph: Graph) -> DataFrame:
    """All violations of a graph in one report (entity_id, code, detail).

    Attribute, invariant and cardinality rules are row-local; only endpoint
    existence and id uniqueness shuffle, and those shuffle keys alone.
    """
    cat = graph.catalog
    parts = []
    for t, d in graph.vertex_tables.items():
        vt = cat.vertex_types[t]
        if vt.attrs or vt.invariants:
            parts.append(attribute_violations(d, "vertex_id", vt.attrs, vt.extensions, invariants=vt.invariants))
    for t, d in graph.edge_tables.items():
        et = cat.edge_types[t]
        if et.attrs or et.invariants:
            parts.append(attribute_violations(d, "edge_id", et.attrs, et.extensions, [p.column for p in et.ports], et.invariants))
        if et.ports:
            parts.append(cardinality_violations(d, et))
    parts.append(endpoint_violations(graph))
    parts.append(id_violations(graph.vertices(), graph.edges()))
    return _union(parts)


def resource_limits(graph: Graph, vertices: int | None = None, edges: int | None = None, incidences: int | None = None) -> DataFrame:
    """Counts against hard limits; a breach is an error for the caller, never a truncation."""
    items = [("vertices", graph.vertices(), vertices), ("edges", graph.edges(), edges), ("incidences", graph.incidences(), incidences)]
    rows = [d.agg(F.lit(n).alias("resource"), F.count(F.lit(1)).alias("used"), F.lit(cap).cast("long").alias("allowed")) for n, d, cap in items]
    return _union(rows).withColumn("exceeded", F.coalesce(F.col("used") > F.col("allowed"), F.lit(False)))


def entity_count(df: DataFrame, equal: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of one exact type whose attributes are present and equal by type and value."""
    types = dict(df.dtypes)
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name) == F.lit(value)) if name in types and _same_kind(types[name], value) else df.filter(F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("count"))


def attribute_sum(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col(name).cast("double")), F.lit(0.0)).alias("total"))


# --- features and adjacency --------------------------------------------------


def structural_features(vertices: DataFrame, flags: Mapping[str, Sequence[str]], counts: Mapping[str, tuple[DataFrame, float]], means: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per-vertex feature row from typed flags, scaled incidence counts and edge means.

    ``counts`` maps a feature to (rows with vertex_id, scale); ``means`` maps a
    feature to (rows with vertex_id, value column).  Every source is grouped by
    vertex with a map-side combine and joined once.
    """
    out = vertices.select("vertex_id", "type_id")
    for name, types in flags.items():
        out = out.withColumn(name, F.col("type_id").isin(*types).cast("double"))
    for name, (rows, scale) in counts.items():
        per = rows.groupBy("vertex_id").agg((F.count(F.lit(1)) / F.lit(float(scale))).alias(name))
        out = out.join(per, "vertex_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    for name, (rows, value) in means.items():
        per = rows.groupBy("vertex_id").agg(F.avg(value).alias(name))
        out = out.join(per, "vertex_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def relation_adjacency(links: DataFrame, symmetric: bool = True) -> DataFrame:
    """Row-normalised adjacency per relation and receiver.

    ``links`` (relation, src, dst, weight) with parallel links summed; with
    ``symmetric`` each link counts in both directions.  The receiver's total comes
    from a second aggregate, so a hub is summed by partial aggregation instead of
    by one window task.
    """
    both = links
    if symmetric:
        both = links.unionByName(links.select("relation", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    w = both.groupBy("relation", "dst", "src").agg(F.sum("weight").alias("weight"))
    total = w.groupBy("relation", "dst").agg(F.sum("weight").alias("_t"))
    return w.join(total, ["relation", "dst"]).select("relation", "dst", "src", F.coalesce(F.try_divide("weight", "_t"), F.lit(0.0)).alias("weight"))


def project_members(edges: DataFrame, members: Sequence[str], relation: str, weight: Column) -> DataFrame:
    """One link per pair of distinct named endpoint columns of an n-ary edge (arity-bounded)."""
    pairs = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for i, a in enumerate(members) for b in members[i + 1:]]
    got = edges.select(F.inline(F.array(*pairs)), weight.alias("weight")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return got.select(F.lit(relation).alias("relation"), "src", "dst", "weight")


def affected_mask(events: DataFrame, keys_by_rule: Mapping[str, Sequence[str]]) -> DataFrame:
    """Matched entities an event touches: the keys its rule names, as (event_id, key, entity_id)."""
    names = F.create_map(*[x for r, ks in keys_by_rule.items() for x in (F.lit(r), F.array(*[F.lit(k) for k in ks]))])
    touched = events.select("event_id", F.col("vertex_map").alias("m"), F.explode(names[F.col("rule_id")]).alias("key"))
    return touched.select("event_id", "key", F.col("m")[F.col("key")].alias("entity_id")).filter("entity_id IS NOT NULL")


def cell_load(association: DataFrame, cell: str, cap: float = 1.5) -> DataFrame:
    """Members per cell over half the population (at least one), capped."""
    per = association.groupBy(cell).agg(F.count(F.lit(1)).alias("members"))
    total = association.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    got = per.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")
    return got.withColumn("load", F.least(F.col("members") / F.greatest(F.col("_n") / 2, F.lit(1.0)), F.lit(cap))).drop("_n")


def head_mask(vertices: DataFrame, applies: Mapping[str, Column]) -> DataFrame:
    """Which base rates apply to a vertex, one boolean column per head."""
    return vertices.select("vertex_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in applies.items()])


def link_quality(received: DataFrame, ue: str = "ue", cell: str = "cell", rsrp: str = "rsrp_dbm", noise_dbm: float = -95.0, max_se: float = 7.4) -> DataFrame:
    """SINR, spectral efficiency, CQI, BLER proxy and neighbour margin per (ue, cell).

    Interference is the ue's total received power minus the own signal, so no pair
    of cells is formed; the best neighbour is the best cell or the runner-up.
    """
    lin = F.pow(F.lit(10.0), F.col(rsrp) / 10)
    per = received.groupBy(ue).agg(F.sum(lin).alias("_sum"), F.max(rsrp).alias("_best"), F.max_by(cell, rsrp).alias("_bc"))
    second = received.join(per.select(ue, "_bc"), ue).filter(F.col(cell) != F.col("_bc")).groupBy(ue).agg(F.max(rsrp).alias("_second"))
    got = received.join(per, ue).join(second, ue, "left")
    noise = F.lit(10.0 ** (noise_dbm / 10))
    s = F.col("sinr_db")
    got = got.withColumn("sinr_db", 10 * F.log10(lin / (F.greatest(F.col("_sum") - lin, F.lit(0.0)) + noise) + 1e-15))
    got = got.withColumn("cqi", F.greatest(F.lit(1.0), F.least(F.lit(15.0), (F.floor((s + 7) / 2) + 1).cast("double"))))
    other = F.when(F.col(cell) == F.col("_bc"), F.col("_second")).otherwise(F.col("_best"))
    return got.select(
        ue, cell, rsrp, "sinr_db", "cqi",
        F.least(F.lit(max_se), F.greatest(F.lit(0.05), F.log2(1 + F.pow(F.lit(10.0), s / 10) / 1.5))).alias("spectral_efficiency"),
        (1 / (1 + F.exp((s - (-5.0 + 1.35 * F.col("cqi"))) / 1.8))).alias("bler_proxy"),
        F.coalesce(other - F.col(rsrp), F.lit(-30.0)).alias("neighbour_margin_db"),
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


