"""Groups of one, rates of zero, facts given twice: a row each, never a failed job."""

import math

from hyperlake.operators import adaptive, admission, bootstrap, eventlog, trust
from hyperlake.sources import notes, telemetry


def test_poisson_draws_of_a_group_of_one(spark):
    df = spark.createDataFrame([("a", 1, 5.0)] + [("b", i, float(i)) for i in range(40)], "g string, i int, v double")
    got = {r["g"]: r for r in bootstrap.bootstrap_mean(df, "v", ["g"], ["i"], draws=200, method="poisson").collect()}
    assert (got["a"]["mean"], got["a"]["lo"], got["a"]["hi"], got["a"]["n"]) == (5.0, 5.0, 5.0, 1)
    assert got["b"]["lo"] < got["b"]["mean"] < got["b"]["hi"]
    strat = bootstrap.stratified_bootstrap_mean(df, "v", ["g"], order=["i"], draws=50, method="poisson").first()
    assert not math.isnan(strat["lo"])


def test_probability_of_a_rule_without_activity(spark):
    df = spark.createDataFrame([("s", "idle", 0.0), ("s", "live", 1.0), ("s", "live", 3.0), ("t", "idle", 0.0)], "k string, rule_id string, hazard double")
    got = {(r["k"], r["rule_id"], r["hazard"]): (r["p_in_rule"], r["p_overall"]) for r in eventlog.selection_probability(df, keys=["k"]).collect()}
    assert got == {("s", "idle", 0.0): (None, 0.0), ("s", "live", 1.0): (0.25, 0.25), ("s", "live", 3.0): (0.75, 0.75), ("t", "idle", 0.0): (None, None)}


ERRORS = "estimand string, regime string, alpha double, scenario int, abs_error double, oracle_effect double"


def test_leave_one_out_of_a_single_scenario(spark):
    rows = [("e", "lone", a, 1, a, 0.5) for a in (0.0, 1.0)] + [("e", "pair", a, s, a + s, 0.5) for a in (0.0, 1.0) for s in (1, 2)]
    got = {(r["regime"], r["scenario"]): (r["alpha"], r["problem"]) for r in trust.loso(spark.createDataFrame(rows, ERRORS)).collect()}
    assert got == {("lone", 1): (None, "no_other_scenario"), ("pair", 1): (0.0, None), ("pair", 2): (0.0, None)}
    known = spark.createDataFrame([(1.0, 0.1)], "alpha double, nmae double")
    got = {(r["regime"], r["scenario"]): (r["alpha"], r["problem"]) for r in trust.loso(spark.createDataFrame(rows, ERRORS), predictive=known, lam=0.2).collect()}
    assert got[("pair", 1)] == (1.0, None) and got[("lone", 1)] == (None, "no_other_scenario")
    none = spark.createDataFrame([], "alpha double, nmae double")
    assert {r["problem"] for r in trust.loso(spark.createDataFrame(rows, ERRORS), predictive=none).collect()} == {"no_other_scenario", "no_predictive_error"}


def test_grid_keeps_alphas_without_predictive_error(spark):
    df = spark.createDataFrame([("e", "r", a, 1, a, 0.5) for a in (0.0, 0.5, 1.0)], ERRORS)
    grid = trust.trust_grid(df, spark.createDataFrame([(0.5, 0.1), (1.0, 0.1)], "alpha double, nmae double"), 0.2)
    assert {(r["alpha"], r["objective"] is None) for r in grid.collect()} == {(0.0, True), (0.5, False), (1.0, False)}
    assert trust.trust_grid_selection(grid).first()["alpha"] == 0.5


def test_explosions_with_and_without_split_keys(spark, tiny_chunks):
    rows = [("hot", i, float(i // 3)) for i in range(60)] + [("calm", i, 100.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "run_id string, event_index int, t double")
    split = {tuple(r) for r in eventlog.explosion_check(df, 1.0, 3).collect()}
    spark.conf.set("hyperlake.rowsPerChunk", "1000")
    whole = {tuple(r) for r in eventlog.explosion_check(df, 1.0, 3).collect()}
    brute = {(k, i, t) for k, i, t in rows for j in [i - 3] if j >= 0 and any(x == (k, j, u) and t - u <= 1.0 for x in rows for u in [x[2]])}
    assert split == whole == brute and whole


def test_one_verdict_for_facts_given_twice(spark):
    msg = spark.createDataFrame([("m", 1, "o", "propose", 1, "part", "c", [], "h", "payload")], "message_id string, seq int, source_owner string, kind string, priority int, name string, constraint string, depends_on array<string>, artifact_hash string, artifact_source string")
    owners = spark.createDataFrame([("o",), ("o",)], "owner string")
    parts = spark.createDataFrame([], "name string")
    concepts = spark.createDataFrame([("c", True)], "concept_id string, requires_fidelity boolean")
    facts = [("part", True, "h", 0, "pass"), ("part", False, "h", 1, "fail")]
    for rows in (facts, facts[::-1]):
        f = spark.createDataFrame(rows, "name string, passed boolean, suite_hash string, exit_code int, outcome string")
        got = admission.classify(msg, owners, parts, concepts, f).collect()
        assert [(r["status"], r["reason"]) for r in got] == [("reject", "runner_failed")]


def test_trace_of_ties_is_the_same_in_any_row_order(spark):
    rows = [("k", 0.0, x, i) for i, x in enumerate([3.0, 1.0, 2.0])]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "k string, t double, x double, i int").repartition(3)
        got = adaptive.eligibility_trace(df, ["k"], "t", "x", 1.0, ties=["i"]).orderBy("i").collect()
        assert [r["trace"] for r in got] == [3.0, 4.0, 6.0]


def test_claim_notes_are_not_doubled_by_a_rerun(spark, tmp_path):
    claims = spark.createDataFrame([(1, "withheld", "why"), (2, "reject", "no")], "scenario int, status string, reason string")
    path = str(tmp_path / "notes")
    for _ in range(2):
        notes.write_claim_notes(claims, path)
    notes.write_claim_notes(claims.filter("status = 'reject'"), path)
    assert {r["status"]: r["n"] for r in spark.read.text(path, wholetext=True).groupBy("status").count().withColumnRenamed("count", "n").collect()} == {"withheld": 1, "reject": 1}


def test_index_counts_usable_lines_only(spark):
    usable = '{"cells":[{"ue_list":[{"rnti":%d}]}]}'
    lines = [(0, ""), (1, '{"cmd":"go","id":1}'), (2, usable % 1), (3, "   "), (4, usable % 2)]
    got = telemetry.parse_native_scheduler(spark.createDataFrame(lines, "n int, value string"), line_no="n", start_time_s=0.0, period_s=0.5).collect()
    assert {r["ue_id"]: r["time_s"] for r in got} == {"1": 0.0, "2": 0.5}
