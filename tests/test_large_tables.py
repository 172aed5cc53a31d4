"""Work that must grow no faster than the tables: what is joined, shuffled and broadcast on the way to a result."""

import pytest
from pyspark.sql import functions as F

from hyperlake.operators import graph as gr


@pytest.fixture
def made(spark, monkeypatch):
    """Rows that reach each ``distinct``."""
    rows, frame = [], type(spark.range(0))
    plain = frame.distinct

    def counted(df):
        rows.append(df.count())
        return plain(df)

    monkeypatch.setattr(frame, "distinct", counted)
    return rows


def test_a_closure_makes_each_pair_of_a_chain_once(spark, made):
    n = gr.subtype_closure(spark.range(1, 151).selectExpr("id as type_id", "id - 1 as parent")).count()
    assert n == 151 * 152 // 2 and sum(made) < 4 * n


def joins(df):
    """The joins of the planned query."""
    return [line.strip() for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]


def test_subjects_and_triples_are_not_broadcast(spark):
    import __spark_entry__ as entry

    found = joins(entry.queries()["triples_shape_check"](spark, "/root/testdata/sf0.001"))
    assert sum("SortMergeJoin" in j for j in found) == 2


def test_smoothing_weights_multiply_blocks_and_not_rows(spark, monkeypatch):
    from hyperlake.operators import adaptive as ad

    given, plain = [], ad.linear_scan
    monkeypatch.setattr(ad, "linear_scan", lambda df, *a, **kw: given.append(df.count()) or plain(df, *a, **kw))
    xs = [float((7 * i * i + 3 * i) % 41) for i in range(700)]
    rows = [(1, i, x) for i, x in enumerate(xs)] + [(2, 0, None), (2, 1, 4.0), (2, 2, None), (2, 3, 6.0)]
    got = {r["k"]: r for r in ad.fit_ema_alpha(spark.createDataFrame(rows, "k INT, t INT, y DOUBLE"), ["k"], ["t"], "y").collect()}

    def mse(a):
        level, total = xs[0], 0.0
        for x in xs[1:]:
            total += (level - x) ** 2
            level = a * x + (1 - a) * level
        return total / (len(xs) - 1)

    best = min((mse(a), a) for a in ad.ALPHA_GRID)
    assert got[1]["alpha"] == best[1] and got[1]["mse"] == pytest.approx(best[0], rel=1e-9) and got[1]["n"] == 700
    assert got[2]["n"] == 4 and sum(given) < len(rows)


def test_ports_of_odd_edges(spark):
    """Repeated and null ids, null vertices, unlisted roles; slots are counted per edge, without a join of all of them."""
    ports = spark.createDataFrame([("T", "tail", "a", "X", 1, 1, True, True, False), ("T", "head", "b", "X", 0, 3, True, False, False), ("U", "head", "c", "Y", 0, None, True, True, True)],
                                  "edge_type STRING, side STRING, role STRING, vertex_type STRING, minimum INT, maximum INT, ordered BOOLEAN, allow_subtypes BOOLEAN, repeated BOOLEAN")
    closure = spark.createDataFrame([("X", "X"), ("Y", "Y"), ("Z", "Z"), ("Z", "X")], "type_id STRING, ancestor STRING")
    vertices = spark.createDataFrame([("x1", "X"), ("x2", "X"), ("y1", "Y"), ("z1", "Z")], "vertex_id STRING, type_id STRING")
    edges = spark.createDataFrame([("e1", "T"), ("e2", "T"), ("e2", "T"), ("e3", "U"), ("e4", "T"), (None, "T")], "edge_id STRING, type_id STRING")
    inc = spark.createDataFrame([
        ("e1", "tail", "a", 0, "z1"), ("e1", "head", "b", 0, "x1"), ("e1", "head", "b", 1, "x1"), ("e1", "head", "q", 0, "x2"), ("e1", "head", "c", 0, "x2"),
        ("e2", "head", "b", 0, "z1"), ("e3", "head", "c", 0, "y1"), ("e3", "head", "c", 1, "y1"), ("e4", "tail", "a", 0, None), ("gone", "tail", "a", 0, "none"), (None, "tail", "a", 0, "x1"),
    ], "edge_id STRING, side STRING, role STRING, ordinal INT, vertex_id STRING")
    df = gr.port_violations(edges, inc, vertices, ports, closure)
    assert not any("FullOuter" in j for j in joins(df))
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted([
        ("e1", "repeated_vertex", "head.b"), ("e1", "unknown_role", "head.q"), ("e1", "unknown_role", "head.c"), ("e2", "below_port_minimum", "tail.a"), ("e2", "below_port_minimum", "tail.a"),
        ("e2", "incompatible_vertex", "z1"), ("e2", "incompatible_vertex", "z1"), ("e4", "repeated_vertex", "tail.a"), ("e4", "unknown_vertex", None), ("gone", "unknown_role", "tail.a"),
        ("gone", "unknown_vertex", "none"), (None, "unknown_role", "tail.a"), (None, "below_port_minimum", "tail.a")], key=str)


def odd_graph(spark):
    """Edges that share ids or have none, ends that come twice or are null, a vertex that comes twice."""
    cat = gr.Catalog([gr.VertexType("X")], [
        gr.EdgeType("One", (gr.Port("tail", "a", "X"), gr.Port("head", "b", "X"))), gr.EdgeType("Many", (gr.Port("tail", "m", "X", 0, None, repeated=True),)), gr.EdgeType("Bare")])
    v = spark.createDataFrame([("v1",), ("v2",), ("v3",), ("v3",), ("v4",)], "vertex_id STRING")
    one = spark.createDataFrame([("e1", "v1", "v2"), ("e2", "v1", "v1"), ("e3", "v1", None), ("e3", "v2", "v1"), (None, "v1", "v2"), (None, "v1", "v3"), ("e4", "v3", "v2")], "edge_id STRING, tail_a STRING, head_b STRING")
    many = spark.createDataFrame([("e4", ["v3", "v3", "v1"]), ("e5", ["v2", "v2", None]), ("e6", None), ("e7", [])], "edge_id STRING, tail_m ARRAY<STRING>")
    return gr.Graph(cat, {"X": v}, {"One": one, "Many": many, "Bare": spark.createDataFrame([("e1",), ("e8",)], "edge_id STRING")})


def test_only_edges_that_share_an_id_are_compared_for_degrees(spark, made):
    g = odd_graph(spark)
    got = sorted(tuple(r) for r in g.degree().collect())
    pairs = {(r["vertex_id"], r["edge_id"]) for r in g.incidences().collect()}
    want = {v: sum(x == v for x, _ in pairs) for v in ("v1", "v2", "v3", "v4")}
    assert got == sorted([(v, "X", want[v]) for v in ("v1", "v2", "v3", "v3", "v4")]) and want["v1"] == 5
    # e2 and e5 have ids of their own
    assert sum(made) < g.incidences().count() - 2


def test_slots_are_counted_without_expanding(spark):
    import __spark_entry__ as entry

    g = odd_graph(spark)
    rows = [r.asDict() for r in g.incidences().collect()]
    want = set()
    for slot in {(r["edge_type"], r["side"], r["role"]) for r in rows}:
        mine = [r for r in rows if (r["edge_type"], r["side"], r["role"]) == slot]
        want.add((*slot, len(mine), len({r["edge_id"] for r in mine} - {None}), len({r["vertex_id"] for r in mine} - {None})))
    assert {tuple(r) for r in g.slot_counts().collect()} == want
    plan = entry.queries()["graph_incidences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan


def test_matches_travel_once_for_a_chain_and_meet_attributes_last(spark, monkeypatch):
    import __spark_entry__ as entry

    from hyperlake.operators import match as mt

    met, plain = [], mt._merge

    def merged(cur, side, *rest):
        if cur is not None and "e_l" in cur.columns:
            met.append([c for c in side.df.columns if c[:2] in ("e_", "v_")])
        return plain(cur, side, *rest)

    monkeypatch.setattr(mt, "_merge", merged)
    for name, vertices in (("match_two_edge_path", []), ("match_guard_with_parameters", [["v_p"]])):
        met.clear()
        entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert met == [["e_pl", "e_li"], ["e_ls"], *vertices]


def test_a_chain_keeps_its_edges_apart(spark):
    """A ring of edges of one type, with ids that repeat, against brute force."""
    from itertools import product

    from hyperlake.operators import match as mt
    from hyperlake.operators.match import E, Pattern, V

    arcs = [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "d"), ("e4", "d", "a"), ("e2", "d", "a"), ("e5", "a", "c"), ("e6", "c", "a"), ("e7", None, "a"), ("e3", "c", "d")]
    cat = gr.Catalog([gr.VertexType("X", (), {"w": gr.Attr("int")})], [gr.EdgeType("Arc", (gr.Port("tail", "s", "X"), gr.Port("head", "t", "X")))])
    v = spark.createDataFrame([(k, i) for i, k in enumerate("abcd")], "vertex_id STRING, w INT")
    g = gr.Graph(cat, {"X": v}, {"Arc": spark.createDataFrame(arcs, "edge_id STRING, tail_s STRING, head_t STRING")})
    for n, ring in ((4, True), (4, False), (3, True)):
        ends = [(i, (i + 1) % n) if ring else (i, i + 1) for i in range(n)]
        p = Pattern([V(f"x{i}", "X") for i in range(n + (not ring))], [E(f"k{i}", "Arc", {"s": [f"x{a}"]}, {"t": [f"x{b}"]}) for i, (a, b) in enumerate(ends)])
        got = sorted((tuple(r) for r in mt.matches(g, p, guard="x0__w >= 0").select(*[f"e_k{i}" for i in range(n)], *[f"v_{x.key}" for x in p.vertices]).collect()), key=str)
        want = []
        for some in product([a for a in arcs if a[1]], repeat=n):
            at = {}
            if all(at.setdefault(k, x) == x for (a, b), (_, s, t) in zip(ends, some, strict=True) for k, x in ((a, s), (b, t))) and len(set(at.values())) == len(at) and len({e for e, _, _ in some}) == n:
                want.append((*[e for e, _, _ in some], *[at[i] for i in range(len(at))]))
        assert got == sorted(want, key=str)


def test_rematch_joins_only_entities_of_the_asked_kind(spark, monkeypatch):
    from hyperlake.operators import match as mt
    from hyperlake.operators.match import E, Pattern, V

    left, plain = [], mt.cut

    def counted(df):
        left.append(df.count())
        return plain(df)

    monkeypatch.setattr(mt, "cut", counted)
    cat = gr.Catalog([gr.VertexType("X"), gr.VertexType("Y")], [gr.EdgeType("Arc", (gr.Port("tail", "s", "X"), gr.Port("head", "t", "Y")))])
    p = Pattern([V("x", "X"), V("y", "Y")], [E("k", "Arc", {"s": ["x"]}, {"t": ["y"]})])

    def graph(xs, ys, arcs):
        return gr.Graph(cat, {"X": spark.createDataFrame([(x,) for x in xs], "vertex_id STRING"), "Y": spark.createDataFrame([(y,) for y in ys], "vertex_id STRING")},
                        {"Arc": spark.createDataFrame(arcs, "edge_id STRING, tail_s STRING, head_t STRING")})

    before = graph(["x1", "x2", "x3"], ["y1", "y2"], [("e1", "x1", "y1"), ("e2", "x2", "y1"), ("e3", "x3", "y2"), ("e4", "x1", "y2")])
    after = graph(["x1", "x2", "x4"], ["y1", "y2"], [("e1", "x1", "y1"), ("e2", "x2", "y2"), ("e4", "x1", "y2"), ("e5", "x4", "y1")])
    touched = spark.createDataFrame([("e2",), ("x3",), ("x4",), ("e5",), ("e3",), (None,)], "entity_id STRING")
    cached = mt.matches(before, p, rule_id="r").select("v_x", "v_y", "e_k", "match_id")
    got = mt.rematch(after, p, cached, touched, rule_id="r")
    want = mt.matches(after, p, rule_id="r").select("v_x", "v_y", "e_k", "match_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 4
    # x3 is gone from the graph and x4 new in it; no entity is a Y
    assert left == [1, 1, 0, 0]
