"""Batches of rules with conditions against firing one match at a time."""

import random

import pytest
from test_match import arc, graph

from hyperlake.operators import rewrite as rw
from hyperlake.operators.match import NAC, PAC, Pattern, V

X, Y, Z, W = (V(k, "Vtx") for k in "xyzw")


def holds(arcs, base, cond):
    """Whether some injective extension of the condition exists around a match."""
    kind, edges = cond
    found = [dict(base)]
    for s, t in edges:
        nxt = []
        for m in found:
            for a, b in arcs:
                n = dict(m)
                if n.setdefault(s, a) == a and n.setdefault(t, b) == b:
                    ends = [v for k, v in n.items() if k in {x for e in edges for x in e}]
                    if len(ends) == len(set(ends)):
                        nxt.append(n)
        found = nxt
    return bool(found) == (kind == "PAC")


def one_at_a_time(arcs, ids, conds, delete):
    """``arcs``: edge id -> (x, y).  Each match deletes its arc or adds the arc back; returns the chosen match ids and final arcs."""
    live, chosen, marks = dict(arcs), [], {}
    start = dict(arcs)
    for m in sorted(ids):
        e, x, y = ids[m]
        base = {"x": x, "y": y}
        own = {x: True, y: True, e: delete}
        for kind, edges in conds:
            if kind == "PAC":
                for a, (s, t) in start.items():
                    (ks, kt), = edges
                    if base.get(ks, s) == s and base.get(kt, t) == t and s != t:
                        for k in (a, s, t):
                            own.setdefault(k, False)
        if any(k in marks and (w or marks[k]) for k, w in own.items()):
            continue
        if not all(holds(list(live.values()), base, c) for c in conds):
            continue
        chosen.append(m)
        for k, w in own.items():
            marks[k] = marks.get(k, False) or w
        if delete:
            live.pop(e)
        else:
            live[f"new-{m}"] = (y, x)
    return chosen, sorted(live.values())


def run(spark, arcs, rule):
    g = graph(spark, sorted({(v, "Vtx", 0) for a in arcs for v in a}), arcs)
    occ = rw.occurrences(g, rule).select("match_id", "e_e", "v_x", "v_y").collect()
    g2, d = rw.apply_batch(g, rule)
    after = sorted((r["tail_s"], r["head_t"]) for r in g2.edge_tables["Arc"].select("tail_s", "head_t").collect())
    return {r["match_id"]: (r["e_e"], r["v_x"], r["v_y"]) for r in occ}, {r["event_id"] for r in d.select("event_id").distinct().collect()}, after


LEFT = Pattern([X, Y], [arc("e", "x", "y")])
RIGHT = [rw.NV("x", "Vtx"), rw.NV("y", "Vtx")]
#: y leads two steps on
TWO_HOPS = [arc("f", "y", "z"), arc("g", "z", "w")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_hop_nac_with_created_arcs(spark, seed):
    r = random.Random(seed)
    arcs = [a for a in sorted({(f"v{r.randrange(18):02}", f"v{r.randrange(18):02}") for _ in range(15)}) if a[0] != a[1]]
    rule = rw.Rule("back", LEFT, RIGHT, [rw.NE("e", "Arc", {"s": ["x"]}, {"t": ["y"]}), rw.NE("n", "Arc", {"s": ["y"]}, {"t": ["x"]})], conditions=[NAC(Pattern([Y, Z, W], TWO_HOPS), {"y": "y"})])
    ids, fired, after = run(spark, arcs, rule)
    # all matches of the pattern, those whose condition fails at first never fire
    want, live = one_at_a_time({f"a{i}": a for i, a in enumerate(arcs)}, ids, [("NAC", [("y", "z"), ("z", "w")])], False)
    assert fired == set(want) and after == live and want


def test_a_winner_breaks_the_condition_of_a_later_match(spark):
    # v1 -> v2 may only get an arc back while v2 leads nowhere in two steps; v3 -> v4 gives it v2 -> v4 -> v3
    arcs = [("v1", "v2"), ("v2", "v4"), ("v3", "v4")]
    rule = rw.Rule("back", LEFT, RIGHT, [rw.NE("e", "Arc", {"s": ["x"]}, {"t": ["y"]}), rw.NE("n", "Arc", {"s": ["y"]}, {"t": ["x"]})], conditions=[NAC(Pattern([Y, Z, W], TWO_HOPS), {"y": "y"})])
    ids, fired, after = run(spark, arcs, rule)
    want, live = one_at_a_time({f"a{i}": a for i, a in enumerate(arcs)}, ids, [("NAC", [("y", "z"), ("z", "w")])], False)
    assert fired == set(want) and after == live


@pytest.mark.parametrize("seed", [4, 5])
def test_witnesses_of_a_pac_are_read(spark, seed):
    r = random.Random(seed)
    arcs = [a for a in sorted({(f"v{r.randrange(9):02}", f"v{r.randrange(9):02}") for _ in range(14)}) if a[0] != a[1]]
    rule = rw.Rule("cut", LEFT, RIGHT, conditions=[PAC(Pattern([Y, Z], [arc("f", "y", "z")]), {"y": "y"})])
    ids, fired, after = run(spark, arcs, rule)
    want, live = one_at_a_time({f"a{i}": a for i, a in enumerate(arcs)}, ids, [("PAC", [("y", "z")])], True)
    assert fired == set(want) and after == live and want


def test_conditions_that_hang_loose_are_refused(spark):
    g = graph(spark, [("a", "Vtx", 0), ("b", "Vtx", 0)], [("a", "b")])
    rule = rw.Rule("loose", LEFT, RIGHT, conditions=[NAC(Pattern([Z, W], [arc("g", "z", "w")]), {})])
    with pytest.raises(ValueError):
        rw.conditional_batch(g, rule, rw.occurrences(g, rule))
