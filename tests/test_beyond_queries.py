"""Cases the given tables do not have: gaps, repeats, nulls, depth, hot keys and more rows than any former limit."""

import pytest
from pyspark.sql import functions as F

from hyperlake import ordered as od
from hyperlake import session
from hyperlake.operators import admission as ad
from hyperlake.operators import bootstrap as boot
from hyperlake.operators import claims as cl
from hyperlake.operators import graph as gr
from hyperlake.operators import match as mt
from hyperlake.operators import rewrite as rw
from hyperlake.operators import trust as tr
from hyperlake.sources import digests as dg
from hyperlake.sources import runs as rs
from hyperlake.sources import telemetry as tm


def test_closure_of_a_deep_chain_and_of_a_cycle(spark):
    chain = spark.range(1, 151).selectExpr("id as type_id", "id - 1 as parent")
    closure = gr.subtype_closure(chain)
    assert closure.count() == 151 * 152 // 2 and gr.subtype_cycles(closure).count() == 0
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "type_id STRING, parent STRING")
    closure = gr.subtype_closure(loop)
    assert closure.count() == 9 + 4
    assert {r["type_id"] for r in gr.subtype_cycles(closure).collect()} == {"a", "b", "c"}


def test_more_rule_instances_than_the_former_limit(spark):
    bindings = spark.range(10_050).selectExpr("id as instance_id", "cast(id as double) as speed")
    matches = spark.createDataFrame([("m1",), ("m2",)], "match_id STRING")
    good, bad = rw.rule_instances(matches, bindings, {"speed": {"lower": 1.0}})
    assert good.count() == 2 * 10_049 and bad.count() == 1


def test_shards_with_another_column_order_are_read_by_name(spark, tmp_path):
    head = ["regime", "scenario", "replicate", "model", "policy", "trust", "goal_utility_ratio", "critical_success_rate", "mean_latency"]
    swapped = head[:6] + ["critical_success_rate", "goal_utility_ratio", "mean_latency"]
    row = "A,1,0,oracle,semantic,1.0,0.5,0.6,x7\n"
    (tmp_path / "a.csv").write_text(",".join(head) + "\n" + row)
    read = rs.read_run_table(spark, str(tmp_path / "a.csv")).first()
    assert read["mean_latency"] is None and read["problem"] == "malformed: mean_latency"
    (tmp_path / "b c.csv").write_text(",".join(swapped) + "\n" + row.replace("A,", "B,"))
    (tmp_path / "d.csv").write_text(",".join([*head, "events"]) + "\n" + row.replace("A,", "D,").strip() + ",12\n")
    got = {r["regime"]: (r["goal_utility_ratio"], r["critical_success_rate"], r["events"]) for r in rs.read_run_table(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"A": (0.5, 0.6, None), "B": (0.6, 0.5, None), "D": (0.5, 0.6, 12)}
    (tmp_path / "e.csv").write_text(",".join(head[:-1]) + "\n")
    with pytest.raises(ValueError, match="mean_latency"):
        rs.read_run_table(spark, str(tmp_path / "*.csv"))


def test_repeats_inside_one_shard_have_one_result(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z")], "k INT, shard INT, v STRING")
    for parts in (1, 3):
        assert [tuple(r) for r in rs.dedup_keep_last(df.repartition(parts), ["k"], "shard").collect()] == [(1, 5, "b")]


def test_null_effects_have_no_sign(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(cl.signed(F.col("x"), 0.5)).collect()] == [None, 0, 1]
    rows = [("e", "A", s, "oracle", p, 1.0 + s * (p == "semantic"), None) for s in (1, 2) for p in ("semantic", "throughput")]
    for s in (1, 2):
        for model, alpha in cl.arm_columns().items():
            if s == 2 and model == "residual_predictive":
                continue
            rows += [("e", "A", s, model, p, 1.0 + s * (p == "semantic"), alpha) for p in ("semantic", "throughput")]
    runs = spark.createDataFrame([(*r[1:3], 0, *r[3:], 1, 1, 1, 1) for r in rows], "regime STRING, scenario INT, replicate INT, model STRING, policy STRING, e DOUBLE, trust DOUBLE, events INT, outages INT, handovers INT, reroutes INT")
    got = {r["scenario"]: r for r in cl.score_table(runs, ["e"]).collect()}
    assert got[1]["status"] == "admit" and got[1]["problem"] is None
    assert got[2]["status"] is None and got[2]["problem"] == "incomplete_ensemble"


def test_a_claim_without_a_foil_cell_keeps_its_row(spark):
    claims = spark.createDataFrame([("e", "A", 1.0, 0.0, "admit", {"1.00": 1.0}), ("e", "B", 1.0, 0.0, "admit", {"1.00": 1.0})], "estimand STRING, regime STRING, oracle_effect DOUBLE, eps DOUBLE, status STRING, effects_by_alpha MAP<STRING, DOUBLE>")
    table = spark.createDataFrame([("e", "A", 1.0)], "estimand STRING, regime STRING, foil_alpha DOUBLE")
    got = {r["regime"]: r["table_direction"] for r in cl.annotate_foils(claims, table).collect()}
    assert got == {"A": "match", "B": "unknown"}


def test_a_group_of_nulls_has_an_interval_of_nan(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, None)], "g STRING, u INT, v DOUBLE")
    got = {r["g"]: r for r in boot.bootstrap_mean(df, "v", ["g"], ["u"], draws=20).collect()}
    assert got["a"]["mean"] == 3.0 and got["b"]["n"] == 0
    assert all(got["b"][c] != got["b"][c] for c in ("mean", "lo", "hi"))


def test_a_cell_without_predictive_errors_keeps_its_row(spark):
    errors = spark.createDataFrame([("e", "A", 0.0, 1.0, 1), ("e", "A", 0.25, 2.0, 1)], "estimand STRING, regime STRING, alpha DOUBLE, abs_error DOUBLE, scenario INT")
    predictive = spark.createDataFrame([(0.5, 0.1)], "alpha DOUBLE, nmae DOUBLE")
    got = tr.select_alpha(tr.cell_objective(errors, predictive)).collect()
    assert [(r["estimand"], r["alpha"]) for r in got] == [("e", None)]


def test_a_concept_given_twice_does_not_multiply_messages(spark):
    msg = spark.createDataFrame([("m", 1, "own", "PROPOSE", 1, "n", "c", None, "h", "payload")], "message_id STRING, seq INT, source_owner STRING, kind STRING, priority INT, name STRING, constraint STRING, depends_on ARRAY<STRING>, artifact_hash STRING, artifact_source STRING")
    owners = spark.createDataFrame([("own",)], "owner STRING")
    parts = spark.createDataFrame([], "name STRING")
    concepts = spark.createDataFrame([("c", True), ("c", False)], "concept_id STRING, requires_fidelity BOOLEAN")
    fidelity = spark.createDataFrame([], "name STRING, suite_hash STRING, passed BOOLEAN, exit_code INT, outcome STRING")
    assert ad.classify(msg.withColumn("kind", F.lit(ad.PROPOSE)), owners, parts, concepts, fidelity).count() == 1


def test_freeze_hands_out_all_drift(spark):
    make = lambda n: spark.range(40).selectExpr("concat('item', id) as item", f"cast(id + {n} as string) as value")
    with pytest.raises(dg.FreezeDriftError) as caught:
        dg.require_freeze(make(0), make(1))
    assert caught.value.drift.count() == 40


def test_differences_keep_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x INT")
    b = spark.createDataFrame([(1,), (3,)], "x INT")
    assert sorted(map(tuple, mt.difference(a, b).collect())) == [(1, "left"), (2, "left"), (3, "right")]


def test_truth_values_are_numbers(spark):
    df = spark.createDataFrame([("true",), ("false",), ("nan",), ("2.5",)], "t STRING")
    assert [r[0] for r in df.select(tm.numeric_or_null(F.col("t"))).collect()] == [1.0, 0.0, None, 2.5]


@pytest.mark.parametrize("kind", ["ties", "prefix"])
def test_hot_keys_split_on_the_whole_order(spark, kind):
    """Ties in all but the last order column, and ids that share a long prefix."""
    df = spark.range(2000).selectExpr("'hot' as k", "0 as t", "0 as r", "concat('prefix-of-all-', lpad(cast(id as string), 8, '0')) as s", "id % 7 as x", "id")
    order = ["t", "r", "id"] if kind == "ties" else ["s"]
    split = od.split_hot(df, ["k"], order, limit=100)
    sizes = [r["count"] for r in split.groupBy(od.CHUNK).count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 2000
    whole = od.running(df, ["k"], order, {"s_": od.rsum("x"), "p": od.rlag("id")})
    pick = lambda d: sorted(map(tuple, d.select("id", "s_", "p").collect()), key=str)
    assert pick(od.running(split, ["k"], order, {"s_": od.rsum("x"), "p": od.rlag("id")})) == pick(whole)


def test_a_cluster_needs_a_named_folder(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "a"})

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Elsewhere)
    named = type("N", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: "hdfs:///shared/")}), "sparkContext": Elsewhere.sparkContext})
    assert session.shared_dir(named) == "hdfs:///shared/hyperlake-a"


def test_streams_remember_ids_and_see_late_events(spark, tmp_path):
    from hyperlake.streaming import stateful as st

    def drained(name, batches, run):
        schema = "run_id STRING, event_id STRING, t DOUBLE, namespace INT, sequence INT, x DOUBLE"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            st.drain(run(spark.readStream.schema(schema).parquet(str(tmp_path / name))), str(tmp_path / f"{name}-out"))
        return spark.read.parquet(str(tmp_path / f"{name}-out" / "rows"))

    event = lambda e, t: ("r", e, t, 0, 0, 0.0)
    got = drained("ingest", [[event("e1", 0.0), event("e2", 5000.0)], [event("e1", 6000.0), event("e3", 4000.0)], [event("e3", 7000.0)]], st.ordered_ingest)
    assert sorted((r["event_id"], r["t"], r["status"]) for r in got.collect()) == [
        ("e1", 0.0, "accepted"), ("e1", 6000.0, "duplicate"), ("e2", 5000.0, "accepted"), ("e3", 4000.0, "late"), ("e3", 7000.0, "accepted"),
    ]
    # values between the bounds, so that the running sum of drops decides
    values = [0.98] * 6 + [0.6] * 12 + [0.98] + [0.6] * 4
    rows = [("r", f"e{k}", float(k), 0, k, v) for k, v in enumerate(values)]
    moves = drained("outage", [rows[:9], rows[9:]], lambda s: st.outage(s, ["run_id"], ["t"], "x")).collect()
    want, was = [], None
    for k in range(len(values)):
        now = st.infer_outage(values[: k + 1])
        if now != was:
            want.append((float(k), now))
        was = now
    assert sorted((r["t"], r["available"]) for r in moves) == want and len(want) > 1


def test_telemetry_names_can_be_given(spark):
    lines = spark.createDataFrame([('{"clock": 3, "quality": 7, "cqi": 1}',)], "value STRING")
    got = tm.parse_kpm(lines, aliases={"time_s": ["clock"], "cqi": ["quality"]}).first()
    assert (got["time_s"], got["cqi"], got["problem"]) == (3.0, 7.0, None)


def test_event_logs_have_a_bounded_number_of_folders(spark, tmp_path):
    from hyperlake.sources import trust_io as io

    io.write_event_log(spark.range(500).selectExpr("id as run_id", "'x' as v"), str(tmp_path / "log"))
    folders = [p for p in (tmp_path / "log").iterdir() if p.is_dir()]
    assert len(folders) <= io.RUN_BUCKETS
    back = io.read_event_log(spark, str(tmp_path / "log"))
    assert back.filter("intact").count() == 500 and set(back.columns) == {"run_id", "v", "record_sha256", "intact"}


def test_the_nested_place_of_a_telemetry_name_counts(spark):
    cases = [
        ('{"time":1,"ue":{"x":{"cqi":1},"cqi":2}}', 1.0), ('{"time":1,"cqi":2,"x":{"cqi":1}}', 1.0), ('{"time":1,"x":{"cqi":1},"cqi":2}', 1.0), ('{"time":1,"l":[{"cqi":1},{"cqi":2}]}', 2.0),
        ('{"time":1,"a":{"cqi":1},"b":{"cqi":2},"cqi":3}', 2.0), ('{"time":1,"a":{"cqi":1,"s":"} { [ \\\\" cqi"},"cqi":3}', 1.0), ('{"time":1,"a":{"b":{"cqi":4},"cqi":5},"c":{"d":1},"cqi":6}', 4.0), ('{"time":1,"cqi":7}', 7.0), ('{"time":1,"cqi":8,"cqi":9}', 9.0),
    ]
    lines = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, value string")
    got = {r["i"]: (r["cqi"], r["problem"]) for r in tm.parse_kpm(lines).collect()}
    assert [got[i][0] for i in range(len(cases))] == [w for _, w in cases]
