"""What grows with the input: links that go round by round, entities that leave, text that is parsed once, rows that are dealt out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hyperlake.operators import compose as cp
from hyperlake.operators import rewrite as rw
from hyperlake.plans import admission_plans
from hyperlake.session import cut
from hyperlake.sources import telemetry as tm


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _written(monkeypatch, module):
    seen = []

    def noted(df):
        got = cut(df)
        seen.append(got)
        return got

    monkeypatch.setattr(module, "cut", noted)
    return seen


def test_links_of_components_shrink(spark, monkeypatch):
    rng = random.Random(3)
    links = [(f"o{rng.randrange(90):03d}", f"p{rng.randrange(60):03d}") for _ in range(110)]
    links += [(f"q{i:03d}", f"q{i + 1:03d}") for i in range(60)] + [("z", "z"), ("y", None), (None, None)] + links[:20]
    root = {x: x for e in links for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    df = spark.createDataFrame(links, "a STRING, b STRING")
    seen = _written(monkeypatch, cp)
    got = [tuple(r) for r in cp.connected_components(None, df).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: top(x) for x in root}
    sizes = [d.count() for d in seen if d.columns == ["a", "b"]][1:]
    assert sizes[-1] == 0 and sizes == sorted(sizes, reverse=True)


def test_components_leave_out_links_to_unknown_nodes(spark):
    nodes = spark.createDataFrame([(1,), (3,), (4,), (5,)], "node LONG")
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a LONG, b LONG")
    assert sorted(tuple(r) for r in cp.connected_components(nodes, links).collect()) == [(1, 1), (3, 3), (4, 4), (5, 4)]


def test_entities_without_writer_leave_the_batch(spark, monkeypatch):
    touch = [(f"m{i}", e, w) for i in range(6) for e, w in (("shared", False), (f"e{i}", True), (f"e{i + 1}", True))]
    seen = _written(monkeypatch, rw)
    got = rw.conflict_free_batch(spark.createDataFrame([*touch, ("free", "shared", False)], "match_id STRING, entity_id STRING, is_write BOOLEAN"))
    assert sorted(r[0] for r in got.collect()) == ["free", "m0", "m2", "m4"]
    later = [d for d in seen if d.columns == ["match_id", "entity_id", "is_write"]][1:]
    assert later and all(d.filter("entity_id = 'shared'").isEmpty() for d in later)


def test_native_lines_are_parsed_once(spark):
    lines = [(i, '{"cells":[{"pci":%d,"ue_list":[{"rnti":"u%d"}]}]}' % (i, i)) for i in (3, 8, 8, 20)] + [(5, '{"cmd":"x"}'), (6, '{"cells":[]}')]
    got = tm.parse_native_scheduler(spark.createDataFrame(lines, "n INT, value STRING"), line_no="n", start_time_s=1.0, period_s=0.5)
    assert sorted((r["n"], r["time_s"], r["ue_id"], r["cell_id"]) for r in got.collect()) == [(3, 1.0, "u3", "3"), (8, 2.0, "u8", "8"), (8, 2.0, "u8", "8"), (20, 2.5, "u20", "20")]
    assert "from_json" not in _plan(got).lower() and "json_object_keys" not in _plan(got).lower()


def test_parts_are_dealt_out_before_they_grow(spark, tmp_path):
    spark.createDataFrame([(1, "s", 2)], "s_suppkey LONG, s_name STRING, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(2, "n")], "n_nationkey INT, n_name STRING").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, "p", "b") for i in (1, 2, 2)], "p_partkey LONG, p_name STRING, p_brand STRING").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    t = admission_plans.triples(spark, str(tmp_path))
    assert t.count() == 5 + 2 + 18 and t.filter(F.col("s") == "urn:p:2").count() == 12
    assert "REPARTITION_BY_COL" in t._jdf.queryExecution().executedPlan().toString()
