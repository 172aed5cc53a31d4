"""Small hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from hyperlake.functions import expressions as ex
from hyperlake.operators import adaptive as ad
from hyperlake.operators import admission as am
from hyperlake.operators import bootstrap as boot
from hyperlake.operators import claims as cl
from hyperlake.operators import effects as fx
from hyperlake.operators import eventlog as el
from hyperlake.operators import inventory as inv
from hyperlake.operators import pointprocess as pp
from hyperlake.operators import trust as tr
from hyperlake.sources import digests as dg
from hyperlake.sources import notes as nt
from hyperlake.sources import runs as rs
from hyperlake.sources import telemetry as tm
from hyperlake.sources import trust_io as io


def test_causal_chain(spark):
    p = spark.createDataFrame([("r", 1, "e1", "A", "write"), ("r", 2, "e2", "A", "read"), ("r", 2, "e2", "B", "write"), ("r", 3, "e3", "A", "read"), ("r", 3, "e3", "B", "read")],
                              "run_id STRING, event_index INT, event_id STRING, entity STRING, mode STRING")
    edges = el.causal_edges(p)
    assert sorted((r["cause"], r["effect"]) for r in edges.collect()) == [("e1", "e2"), ("e1", "e3"), ("e2", "e3")]
    t = spark.createDataFrame([("r", "e3")], "run_id STRING, event_id STRING")
    assert sorted(r["event_id"] for r in el.reachable(edges, t).collect()) == ["e1", "e2"]


def test_likelihood(spark):
    ev = spark.createDataFrame([("r", "internal", 1.0, 0.5, 1.0), ("r", "internal", 3.0, 0.25, 2.0), ("r", "external", None, 0.25, 3.0)], "run_id STRING, kind STRING, hazard DOUBLE, survival_integral DOUBLE, t DOUBLE")
    term = spark.createDataFrame([("r", 3.5, 4.0)], "run_id STRING, terminal_time DOUBLE, terminal_activity DOUBLE")
    got = el.path_likelihood(ev, term).first()
    assert (round(got["log_hazard_sum"], 6), got["integrated_activity"], round(got["log_likelihood"], 6)) == (1.098612, 3.0, -1.901388)


def test_weighted_select(spark):
    items = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 0.0), ("g", "c", 3.0)], "g STRING, item STRING, w DOUBLE")
    draws = spark.createDataFrame([("g", "1", 0.24), ("g", "2", 0.25), ("g", "3", 0.999999)], "g STRING, draw STRING, u DOUBLE")
    got = {r["draw"]: r["item"] for r in el.weighted_select(items, draws, ["g"], "item", "w").collect()}
    assert got == {"1": "a", "2": "c", "3": "c"}


def test_ensemble_summary(spark):
    got = fx.ensemble_summary(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v DOUBLE"), "v").first()
    assert [round(got[c], 6) for c in ("mean", "stdev", "q05", "median", "q95")] == [2.333333, 1.527525, 1.1, 2.0, 3.8]
    one = fx.ensemble_summary(spark.createDataFrame([(5.0,)], "v DOUBLE"), "v").first()
    assert one["stdev"] == 0.0 and one["q95"] == 5.0


def test_point_process(spark):
    r = spark.createDataFrame([(1, 0, "a", 2.0, 1, 0.25), (1, 0, "b", 0.5, 0, 0.25), (1, 0, "c", 1.5, 2, 0.25)], "trace INT, i INT, mark STRING, rate DOUBLE, n INT, dt DOUBLE")
    got = r.agg(F.sum(pp.nll_term())).first()[0]
    assert math.isclose(got, 1 - math.log(2) - 2 * math.log(1.5), abs_tol=1e-12)
    rates = spark.createDataFrame([(1, "m", 0.0, 2.0, 1.0), (1, "m", 1.0, 1.0, 1.0), (1, "m", 2.0, 4.0, 1.0)], "trace INT, mark STRING, t DOUBLE, rate DOUBLE, dt DOUBLE")
    ev = spark.createDataFrame([(1, "m", t) for t in (0.5, 1.5, 2.25)], "trace INT, mark STRING, t DOUBLE")
    assert [round(x["increment"], 9) for x in pp.compensator_increments(rates, ev, 3.0).orderBy("t").collect()] == [1.5, 1.5]


def test_sparsify_keeps_totals(spark):
    rows = [(1, i, float(i), 1.0, i % 3, 1, 0.5 * i) for i in range(30)]
    iv = spark.createDataFrame(rows, "trace INT, i INT, t DOUBLE, dt DOUBLE, n_a INT, n_b INT, r DOUBLE")
    out = pp.sparsify_trace(iv, ["a", "b"], 0.4, 3, ["r"])
    total = lambda d: d.agg(F.sum("n_a"), F.sum("n_b"), F.sum("dt"), F.round(F.sum(F.col("r") * F.col("dt")), 9)).first()
    assert total(iv) == total(out) and 2 <= out.count() < 30


def test_adaptive(spark):
    z = ad.eligibility_trace(spark.createDataFrame([("k", 0.0, 1.0), ("k", 2.0, 1.0)], "k STRING, t DOUBLE, x DOUBLE"), ["k"], "t", "x", 2.0)
    assert [round(r["trace"], 6) for r in z.orderBy("t").collect()] == [1.0, 1.367879]
    s = spark.createDataFrame([("k", i, v) for i, v in enumerate((0.0, 1.2, 2.0, 2.4))], "k STRING, i INT, v DOUBLE")
    got = ad.load_level(s, ["k"], ["i"], "v").first()
    assert round(got["smoothed"], 5) == 1.47245 and got["load"] == 1
    two = spark.createDataFrame([("a", i, v) for i, v in enumerate((1.0, 1.0, 0.98))] + [("b", i, v) for i, v in enumerate((1.0, 1.0, 0.0))], "k STRING, i INT, v DOUBLE")
    assert {r["k"]: r["available"] for r in ad.cusum_outage(two, ["k"], ["i"], "v").collect()} == {"a": True, "b": False}


def test_long_decay_stays_finite(spark):
    n = 5000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    want = None
    for i in range(n):
        want = float(i % 7) if want is None else 0.35 * (i % 7) + 0.65 * want
    assert math.isclose(ad.load_level(df, ["k"], ["i"], "v", capacity=100).first()["smoothed"], want, rel_tol=1e-9)


def errors(spark, rows):
    return spark.createDataFrame(rows, "estimand STRING, regime STRING, scenario INT, alpha DOUBLE, abs_error DOUBLE")


def test_trust_selection(spark):
    e = errors(spark, [("g", "a", 0, a, 1.0) for a in (0.0, 0.25, 1.0)] + [("g", "b", 0, 1.0, 0.5), ("g", "b", 0, 0.25, 0.5)] + [("g", "c", 0, 0.0, 0.1), ("g", "c", 0, 0.5, 0.1), ("g", "c", 0, 1.0, 0.2)])
    plain = {r["regime"]: r["alpha"] for r in tr.select_alpha(tr.cell_objective(e)).collect()}
    assert plain["a"] == 0.0 and plain["b"] == 0.25
    pred = spark.createDataFrame([(0.0, 0.05), (0.5, 0.01), (1.0, 0.0)], "alpha DOUBLE, nmae DOUBLE")
    assert {r["regime"]: r["alpha"] for r in tr.select_alpha(tr.cell_objective(e.filter("regime = 'c'"), pred, 0.1)).collect()} == {"c": 0.5}


def test_empty_field_falls_back(spark):
    cells = tr.fit(errors(spark, []))
    q = spark.createDataFrame([("mean_latency", "semantic_vs_throughput", "weak_channel")], "estimand STRING, intervention STRING, regime STRING")
    got = tr.lookup(cells, q).first()
    assert (got["alpha"], got["source"], got["notes"]) == (0.0, "default_mechanistic", "unknown_estimand")


@pytest.mark.parametrize("oracle, effects, status", [
    (0.2, (0.18, 0.21, 0.19, 0.22), "admit"), (0.2, (0.1, 0.1, -0.1, 0.1), "hold_unresolved"), (0.2, (0.1, 0.0, 0.1, 0.1), "hold_unresolved"),
    (0.2, (-0.1, -0.1, -0.2, -0.1), "reject"), (0.2, (0.0, 0.0, 0.0, 0.0), "reject"), (0.0, (0.1, 0.1, 0.1, 0.1), "outcome_unknown"),
])
def test_claim_statuses(spark, oracle, effects, status):
    m = dict(zip(("0.00", "0.25", "0.50", "1.00"), effects))
    df = spark.createDataFrame([("g", "r", 1, oracle, m, True)], "estimand STRING, regime STRING, scenario INT, oracle_effect DOUBLE, effects_by_alpha MAP<STRING,DOUBLE>, response_activation BOOLEAN")
    assert cl.score(df).first()["status"] == status


def test_student_and_normal_tails(spark):
    got = spark.range(1).select(
        boot.student_p_two_sided(F.lit(2.228138852), F.lit(10.0)), boot.student_quantile_975(F.lit(10.0)), boot.student_quantile_975(F.lit(1.0)), boot.student_quantile_975(F.lit(4.0)),
        boot.normal_p_two_sided(F.lit(1.959963985)), boot.student_p_two_sided(F.lit(1.0), F.lit(3.7))).first()
    assert [round(x, 6) for x in got] == [0.05, 2.228139, 12.706205, 2.776445, 0.05, 0.378356] or [round(x, 5) for x in got[:5]] == [0.05, 2.22814, 12.7062, 2.77645, 0.05]


def test_bootstrap_centre_and_methods(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 21)], "u INT, v DOUBLE")
    exact = boot.bootstrap_mean(df, "v", order=["u"], draws=400).first()
    poisson = boot.bootstrap_mean(df, "v", order=["u"], draws=400, method="poisson").first()
    assert exact["mean"] == 10.5 and exact["n"] == 20
    assert 7.0 < exact["lo"] < 9.0 < 12.0 < exact["hi"] < 14.0
    assert abs(poisson["lo"] - exact["lo"]) < 1.5 and abs(poisson["hi"] - exact["hi"]) < 1.5


def test_telemetry(spark):
    line = '{"time_s":0.0,"rnti":42,"pci":7,"CQI":11,"RSRP":-87.5,"DRB.UEThpDl":82.0,"DRB.RlcPacketDropRateDl":2.5,"DRB.PacketSuccessRateUlgNBUu":98.5}'
    got = tm.parse_kpm(spark.createDataFrame([(line,), ("",), ('{"cmd":"x"}',)], "value STRING")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["dl_drop_rate"], r["ul_success_rate"], r["ue_id"], r["cell_id"], r["cqi"]) == (0.025, 0.985, "42", "7", 11.0)
    native = '{"timestamp":"2026-08-18T10:00:00Z","cells":[{"cell_metrics":{"pci":17},"ue_list":[{"rnti":17921,"cqi":12,"dl_brate":42000,"ul_brate":6500,"dl_nof_ok":98,"dl_nof_nok":2,"ul_nof_ok":49,"ul_nof_nok":1}]}]}'
    n = tm.parse_native_scheduler(spark.createDataFrame([(0, native)], "n INT, value STRING"), line_no="n", start_time_s=0.0, period_s=0.5).first()
    assert (n["dl_throughput_mbps"], n["ul_throughput_mbps"], n["dl_drop_rate"], n["ul_success_rate"], n["time_s"], n["cell_id"]) == (42.0, 6.5, 0.02, 0.98, 0.0, "17")


def test_strict_decode(spark):
    ok = '{"event_id":"e","sku":"s","kind":"receive","quantity":3}'
    bad = [ok.replace("3", x) for x in ("0", "-1", "true", '"2"', "2.0")] + [ok.replace('"s"', '""'), ok.replace("receive", "return"), ok.replace("}", ',"x":1}'), "[1]", "nope"]
    got = inv.decode_event(spark.createDataFrame([(x,) for x in [ok, *bad]], "raw STRING")).collect()
    assert [r["raw"] for r in got if r["problem"] is None] == [ok]


def test_admissibility(spark):
    text = "---\nconcept_id: critical\nexcludes:\n  - outage\nrequires_fidelity: true\ndegraded_fidelity_edges: [MEC-fast]\n---\nsee [[background]] and [[background]]\n"
    other = "---\nconcept_id: background\nrequires_fidelity: false\n---\nbody"
    notes = nt.parse_notes(spark.createDataFrame([("a", text), ("b", other), ("c", "no matter")], "path STRING, value STRING"))
    by = {r["path"]: r for r in notes.collect()}
    assert by["a"]["wikilinks"] == ["background"] and by["a"]["excludes"] == ["outage"] and by["c"]["problem"] == "no_front_matter"
    t = spark.createDataFrame([("critical", "MEC-fast", False), ("background", "MEC-fast", False), ("other", "x", False)], "task_kind STRING, edge_name STRING, outage BOOLEAN")
    assert {r["task_kind"]: (r["admissible"], r["problem"]) for r in nt.admissible(t, notes).collect()} == {"critical": (False, None), "background": (True, None), "other": (None, "unknown_kind")}


def test_files(spark, tmp_path):
    csv = tmp_path / "runs.csv"
    csv.write_text("regime,scenario,replicate,model,policy,trust,goal_utility_ratio,critical_success_rate,mean_latency,seed\nid,1,0,oracle,semantic,1.0,0.5,0.6,0.7,10485945941293656736\n")
    r = rs.read_run_table(spark, str(csv)).first()
    assert r["seed"] == "10485945941293656736" and r["goal_utility_ratio"] == 0.5
    (tmp_path / "bad.csv").write_text("regime\nid\n")
    with pytest.raises(ValueError):
        rs.read_run_table(spark, str(tmp_path / "bad.csv"))
    for n, b in (("b.md", b"two"), ("a.md", b"one")):
        (tmp_path / n).write_bytes(b)
    import hashlib

    assert {r["name"]: r["sha256"] for r in dg.checksum_files(spark, str(tmp_path / "*.md")).collect()}["a.md"] == hashlib.sha256(b"one").hexdigest()
    log = spark.createDataFrame([("r1", 1, "x"), ("r2", 2, "y")], "run_id STRING, i INT, v STRING")
    io.write_event_log(log, str(tmp_path / "log"))
    assert io.read_event_log(spark, str(tmp_path / "log")).filter("intact").count() == 2
    claims = spark.createDataFrame([(3, "reject", "why")], "scenario INT, status STRING, reason STRING")
    nt.write_claim_notes(claims, str(tmp_path / "notes"))
    assert nt.scan_notes(spark, str(tmp_path / "notes" / "*")).first()["concept_id"] == "claim-3-reject"
    (tmp_path / "t.nt").write_text('<urn:a> <urn:p> "x" .\n# note\n')
    assert am.read_triples(spark, str(tmp_path / "t.nt")).first()["o"] == "x"
    a = dg.freeze_manifest(spark, {"seed": 1}, {"log": log})
    dg.require_freeze(a, a)
    with pytest.raises(ValueError):
        dg.require_freeze(a, dg.freeze_manifest(spark, {"seed": 2}, {"log": log}))


def test_expressions_are_checked(spark):
    df = spark.createDataFrame([(2.5, -3.0)], "a DOUBLE, b DOUBLE")
    f = lambda t: df.select(ex.checked(t, df.columns)).first()[0]
    assert f("round(a)") == 2.0 and f("clip(b, -1, 1)") == -1.0 and f("min(a, b)") == -3.0 and f("abs(b) > a and not (a = b)") is True
    assert f("softplus(a * 100)") == 250.0 and f("isfinite(a / 0.5)") is True
    assert f("2 ** 3 ** 2") == 512.0 and f("-a ** 2") == -6.25 and f("7 * 3 // 2 - b // 2") == 12 and f("1 + -7 // 2") == -3
    assert f("softplus(b * 20)") > 0 and f("clip(max(a, b), 0, 1) + (a + 1) * 2") == 8.0
    many = spark.createDataFrame([([1.0, 2.0, 3.5],)], "xs ARRAY<DOUBLE>")
    assert many.select(ex.checked("sum(xs) / len(xs)", ["xs"])).first()[0] == 6.5 / 3
    for text in ("c + 1", "reflect('x', 'y')", "a; b"):
        with pytest.raises(ValueError):
            f(text)


def test_stream_equals_batch_inference():
    from hyperlake.streaming.stateful import infer_outage

    assert infer_outage([1, 1, 0.98]) and not infer_outage([1, 1, 0]) and not infer_outage([1, 1, 0.4]) and infer_outage([0.2, 0.99])


def test_message_priority_never_beats_legality(spark):
    m = spark.createDataFrame(
        [("1", 1, "mouth", "spawn", 1, "bob", "", [], None, None), ("2", 2, "mouth", "propose", 99, "c1", "rule", [], "h", "payload"), ("3", 3, "mouth", "propose", 5, "c2", "free", ["gone"], "h", "payload")],
        "message_id STRING, seq INT, source_owner STRING, kind STRING, priority INT, name STRING, constraint STRING, depends_on ARRAY<STRING>, artifact_hash STRING, artifact_source STRING")
    owners = spark.createDataFrame([("mouth",)], "owner STRING")
    none = spark.createDataFrame([], "name STRING")
    concepts = spark.createDataFrame([("rule", True), ("free", False)], "concept_id STRING, requires_fidelity BOOLEAN")
    fid = spark.createDataFrame([], "name STRING, passed BOOLEAN, suite_hash STRING, exit_code INT, outcome STRING")
    got = {r["message_id"]: (r["status"], r["reason"]) for r in am.classify(m, owners, none, concepts, fid).collect()}
    assert got == {"1": ("admit", "owner_registered"), "2": ("reject", "runner_absent"), "3": ("hold_unresolved", "missing_dependency")}
