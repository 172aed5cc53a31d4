"""Patterns against an independent nested-loop enumerator."""

import itertools
import random

import pytest

from hyperlake.operators import match as mt
from hyperlake.operators import rewrite as rw
from hyperlake.operators.graph import Catalog, EdgeType, Graph, Port, VertexType, from_tables, validate_graph
from hyperlake.operators.match import E, NAC, PAC, Pattern, V, Var

ARC = EdgeType("Arc", (Port("tail", "s", "Vtx"), Port("head", "t", "Vtx")))
BAG = EdgeType("Bag", (Port("tail", "m", "Vtx", 2, None, ordered=False, repeated=True),))
TUP = EdgeType("Tup", (Port("tail", "m", "Vtx", 2, None, ordered=True, repeated=True),))
CAT = Catalog([VertexType("Vtx"), VertexType("Sub", ("Vtx",))], [ARC, BAG, TUP])


def graph(spark, vertices, arcs, bags=(), tuples=()):
    v = {t: spark.createDataFrame([(i, x) for i, ty, x in vertices if ty == t], "vertex_id STRING, x INT") for t in ("Vtx", "Sub")}
    e = {
        "Arc": spark.createDataFrame([(f"a{i}", s, t) for i, (s, t) in enumerate(arcs)], "edge_id STRING, tail_s STRING, head_t STRING"),
        "Bag": spark.createDataFrame([(f"b{i}", list(m)) for i, m in enumerate(bags)], "edge_id STRING, tail_m ARRAY<STRING>"),
        "Tup": spark.createDataFrame([(f"t{i}", list(m)) for i, m in enumerate(tuples)], "edge_id STRING, tail_m ARRAY<STRING>"),
    }
    return Graph(CAT, v, e)


def brute(vertices, edges, pattern):
    """All injective maps, by trying every assignment."""
    types = {"Vtx": {"Vtx", "Sub"}, "Sub": {"Sub"}}
    info = {i: (t, x) for i, t, x in vertices}
    keys = [v.key for v in pattern.vertices]
    out = set()
    for vs in itertools.permutations(info, len(keys)):
        vm = dict(zip(keys, vs))
        ok = all(info[vm[v.key]][0] in (types[v.type] if v.subtypes else {v.type}) for v in pattern.vertices)
        bound = {}
        for v in pattern.vertices if ok else ():
            for _, term in v.attrs.items():
                val = info[vm[v.key]][1]
                if isinstance(term, Var):
                    ok = ok and bound.setdefault(term.name, val) == val
                else:
                    ok = ok and val == term
        if not ok:
            continue
        for es in itertools.permutations(edges, len(pattern.edges)):
            good = True
            for pe, (name, kind, ends) in zip(pattern.edges, es):
                want = [vm[k] for _, _, ks in pe.slots() for k in ks]
                same = sorted(want) == sorted(ends) if kind == "Bag" else want == list(ends)
                good = good and pe.type == kind and same
            if good:
                out.add((tuple(vs), tuple(e[0] for e in es)))
    return out


def found(g, pattern):
    df = mt.find(g, pattern)
    vs, es = [f"v_{v.key}" for v in pattern.vertices], [f"e_{e.key}" for e in pattern.edges]
    got = [(tuple(r[c] for c in vs), tuple(r[c] for c in es)) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def arc(key, s, t):
    return E(key, "Arc", {"s": [s]}, {"t": [t]})


PATTERNS = [
    Pattern([V("a", "Vtx"), V("b", "Vtx"), V("c", "Vtx")], [arc("x", "a", "b"), arc("y", "b", "c")]),
    Pattern([V("a", "Vtx")], [arc("x", "a", "a")]),
    Pattern([V("a", "Sub"), V("b", "Vtx", subtypes=False)], [arc("x", "a", "b")]),
    Pattern([V("a", "Vtx"), V("b", "Vtx")], [arc("x", "a", "b"), arc("y", "a", "b")]),
    Pattern([V("a", "Vtx"), V("b", "Vtx")], [E("m", "Bag", {"m": ["a", "b"]}), arc("x", "a", "b")]),
    Pattern([V("a", "Vtx"), V("b", "Vtx")], [E("m", "Bag", {"m": ["a", "a", "b"]})]),
    Pattern([V("a", "Vtx"), V("b", "Vtx")], [E("m", "Tup", {"m": ["a", "b", "a"]})]),
    Pattern([V("a", "Vtx", {"x": Var("q")}), V("b", "Vtx", {"x": Var("q")})], [arc("x", "a", "b")]),
    Pattern([V("a", "Vtx", {"x": 1}), V("b", "Vtx")], [arc("x", "b", "a")]),
]


@pytest.mark.parametrize("seed", range(3))
def test_random_multigraphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(5)]
    vertices = [(i, rng.choice(["Vtx", "Sub"]), rng.randrange(3)) for i in ids]
    arcs = [(rng.choice(ids), rng.choice(ids)) for _ in range(8)]
    bags = [[rng.choice(ids) for _ in range(rng.choice([2, 3]))] for _ in range(4)]
    tuples = [[rng.choice(ids) for _ in range(3)] for _ in range(4)]
    g = graph(spark, vertices, arcs, bags, tuples)
    edges = [(f"a{i}", "Arc", list(e)) for i, e in enumerate(arcs)] + [(f"b{i}", "Bag", m) for i, m in enumerate(bags)] + [(f"t{i}", "Tup", m) for i, m in enumerate(tuples)]
    for p in PATTERNS:
        assert found(g, p) == brute(vertices, edges, p), p


def test_all_three_vertex_digraphs_at_once(spark):
    """512 digraphs as disjoint parts of one graph; the two-edge path matches in each as by hand."""
    ids, slots = ["a", "b", "c"], list(itertools.product("abc", repeat=2))
    vertices, arcs, want = [], [], 0
    for mask in range(512):
        vertices += [(f"{mask}.{i}", "Vtx", 0) for i in ids]
        here = [s for k, s in enumerate(slots) if mask >> k & 1]
        arcs += [(f"{mask}.{s}", f"{mask}.{t}") for s, t in here]
        want += sum(1 for p, q in itertools.permutations(here, 2) if p[1] == q[0] and len({p[0], p[1], q[1]}) == 3)
    assert mt.find(graph(spark, vertices, arcs), PATTERNS[0]).count() == want


def test_ring_and_anchor(spark):
    n = 24
    g = graph(spark, [(f"n{i}", "Vtx", i) for i in range(n)], [(f"n{i}", f"n{(i + 1) % n}") for i in range(n)])
    p = Pattern([V("a", "Vtx"), V("b", "Vtx")], [arc("x", "a", "b")])
    assert mt.find(g, p).count() == n
    assert mt.find(g, p, anchors=spark.createDataFrame([("n3",)], "v_a STRING")).count() == 1
    assert mt.find(g, p, anchors=spark.createDataFrame([("gone",)], "v_a STRING")).count() == 0
    with pytest.raises(ValueError):
        mt.find(g, p, anchors=spark.createDataFrame([("n3",)], "v_zzz STRING"))


def test_unordered_members_give_two_images(spark):
    g = graph(spark, [("a", "Vtx", 0), ("b", "Sub", 0)], [], bags=[["a", "b"]])
    assert mt.find(g, Pattern([V("x", "Vtx"), V("y", "Vtx")], [E("m", "Bag", {"m": ["y", "x"]})])).count() == 2


def test_conditions(spark):
    g = graph(spark, [("a", "Vtx", 0), ("b", "Vtx", 0)], [("a", "b")])
    one = Pattern([V("x", "Vtx")])
    out = Pattern([V("x", "Vtx"), V("y", "Vtx")], [arc("e", "x", "y")])
    pick = lambda c: [r["v_x"] for r in mt.matches(g, one, conditions=[c]).collect()]
    assert pick(NAC(out, {"x": "x"})) == ["b"]
    assert pick(PAC(out, {"x": "x"})) == ["a"]


def test_disconnected_pattern_must_be_asked_for(spark):
    g = graph(spark, [("a", "Vtx", 0), ("b", "Vtx", 0)], [])
    p = Pattern([V("x", "Vtx"), V("y", "Vtx")])
    with pytest.raises(ValueError):
        mt.find(g, p)
    assert mt.find(g, p, allow_cartesian=True).count() == 2


def test_typed_variables_do_not_coerce(spark):
    cat = Catalog([VertexType("A"), VertexType("B")], [EdgeType("L", (Port("tail", "s", "A"), Port("head", "t", "B")))])
    g = Graph(cat, {"A": spark.createDataFrame([("a", 1)], "vertex_id STRING, x INT"), "B": spark.createDataFrame([("b", 1.0)], "vertex_id STRING, x DOUBLE")},
              {"L": spark.createDataFrame([("l", "a", "b")], "edge_id STRING, tail_s STRING, head_t STRING")})
    p = Pattern([V("a", "A", {"x": Var("q")}), V("b", "B", {"x": Var("q")})], [E("l", "L", {"s": ["a"]}, {"t": ["b"]})])
    assert mt.find(g, p).count() == 0


def test_dangling_and_rewrite(spark):
    g = graph(spark, [("a", "Vtx", 1), ("b", "Vtx", 2)], [("a", "b")])
    lone = rw.Rule("drop", Pattern([V("x", "Vtx")]), [])
    assert rw.occurrences(g, lone).count() == 0
    whole = rw.Rule("drop-arc", PATTERNS[0].__class__([V("x", "Vtx"), V("y", "Vtx")], [arc("e", "x", "y")]), [rw.NV("y", "Vtx", {"x": rw.Ex("y__x + 5")})], hazard="0.5 * 2")
    occ = rw.occurrences(g, whole, keep_attrs=["x", "y", "e"])
    assert [r["hazard"] for r in occ.collect()] == [1.0]
    g2, d = rw.apply_batch(g, whole)
    assert sorted((r["op"], r["entity_id"]) for r in d.collect()) == [("delete", "a"), ("delete", "a0"), ("update", "b")]
    assert [tuple(r) for r in g2.vertex_tables["Vtx"].collect()] == [("b", 7)]
    assert g2.edge_tables["Arc"].count() == 0


def test_conflict_free_batch_is_greedy(spark):
    rng = random.Random(5)
    touch = [(f"m{i:02d}", f"e{rng.randrange(9)}", rng.random() < 0.5) for i in range(25) for _ in range(3)]
    rows = {}
    for m, e, w in touch:
        rows[(m, e)] = rows.get((m, e), False) or w
    df = spark.createDataFrame([(m, e, w) for (m, e), w in rows.items()], "match_id STRING, entity_id STRING, is_write BOOLEAN")
    chosen = []
    for m in sorted({k[0] for k in rows}):
        mine = {e: w for (x, e), w in rows.items() if x == m}
        clash = any(rows.get((c, e)) is not None and (w or rows[(c, e)]) for c in chosen for e, w in mine.items())
        if not clash:
            chosen.append(m)
    assert sorted(r["match_id"] for r in rw.conflict_free_batch(df).collect()) == chosen


def test_round_trip_and_validation(spark):
    g = graph(spark, [("a", "Vtx", 0), ("b", "Sub", 0)], [("a", "b")], bags=[["a", "b", "b"]], tuples=[["b", "a"]])
    assert validate_graph(g).count() == 0
    plain = {t: d.select("edge_id") for t, d in g.edge_tables.items()}
    back = from_tables(CAT, g.vertex_tables, plain, g.incidences())
    for t, d in g.edge_tables.items():
        assert sorted(map(str, back.edge_tables[t].select(*d.columns).collect())) == sorted(map(str, d.collect()))
