"""Registered queries: telemetry, notes, digests, triples and table round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import admission as ad
from ..operators import graph as gr
from ..operators import trust as tr
from ..session import shared_dir
from ..sources import digests as dg
from ..sources import notes as nt
from ..sources import runs as rs
from ..sources import telemetry as tm
from ..sources import trust_io as io
from .data import EFFECTS, RUNS, q6, r6, runs, table
from .event_data import BASE, LOG, base, log
from .registry import query
from .tpch_graph import graph
from .trust_plans import CELLS, OBJ, PRED, errors, predictive


def kpm_lines(spark, sf):
    """One JSON line per event; nesting, aliases, envelopes and broken lines vary."""
    b = base(spark, sf)
    m = F.col("event_id") % 6
    c = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    v, k, t = F.col("value").cast("string"), F.col("k").cast("string"), F.col("event_id").cast("string")
    line = (
        F.when(m == 0, c('{"time_s":', t, ',"rnti":', F.col("user_id").cast("string"), ',"pci":7,"CQI":', k, ',"DRB.UEThpDl":', v, ',"DRB.RlcPacketDropRateDl":', k, "}"))
        .when(m == 1, c('{"timestamp":', t, ',"ue":{"ue_id":"u', F.col("user_id").cast("string"), '"},"m":{"cell":{"cell_id":"c1"},"sinr":', v, ',"wb_cqi":null}}'))
        .when(m == 2, c('{"cmd":"subscribe","id":', t, "}")).when(m == 3, c('{"time_s":', t, ',"CQI":')).when(m == 4, c('{"CQI":', k, ',"RSRP":-', v, "}"))
        .otherwise(c('{"list":[{"time":', t, ',"ul_success_rate":', v, ',"dl_volume_bytes":', k, "}]}"))
    )
    return b.select("event_id", line.alias("value"))


KPM = BASE + """, kp AS (SELECT event_id, event_id % 6 AS m, user_id, value, k FROM base WHERE event_id % 6 <> 2)
SELECT event_id, CASE WHEN m IN (0, 1, 5) THEN event_id::DOUBLE WHEN m = 3 THEN event_id::DOUBLE END AS time_s, CASE m WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN 'u' || user_id END AS ue_id, CASE m WHEN 0 THEN '7' WHEN 1 THEN 'c1' END AS cell_id,
 CASE WHEN m IN (0, 4) THEN k::DOUBLE END AS cqi, CASE WHEN m = 4 THEN -value END AS rsrp_dbm, CASE WHEN m = 1 THEN value END AS sinr_db, CASE WHEN m = 0 THEN value * 2 END AS dl_throughput_mbps,
 CASE WHEN m = 0 THEN CASE WHEN k > 1 THEN k / 100.0 ELSE k END END::DOUBLE AS dl_drop_rate, CASE WHEN m = 5 THEN CASE WHEN value > 1 THEN value / 100 ELSE value END END AS ul_success_rate,
 CASE WHEN m = 5 THEN k::DOUBLE END AS dl_volume_bytes, CASE WHEN m = 3 THEN 'invalid_json' WHEN m = 4 THEN 'no_time' END AS problem FROM kp"""


@query("telemetry_kpm_lines", f"WITH {KPM}")
def kpm(spark, sf):
    got = tm.parse_kpm(kpm_lines(spark, sf), throughput_scale=2.0)
    return got.select("event_id", "time_s", "ue_id", "cell_id", "cqi", "rsrp_dbm", "sinr_db", "dl_throughput_mbps", "dl_drop_rate", "ul_success_rate", "dl_volume_bytes", "problem")


@query("telemetry_native_scheduler_lines", f"""WITH {BASE}, x AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM base)
SELECT event_id, 5 + i * 0.5::DOUBLE AS time_s, ue.ue_id, CASE WHEN ue.u = 1 THEN '9' ELSE '17' END AS cell_id, value / 1000 AS dl_throughput_mbps, {q6('CASE WHEN k > 0 THEN (k % 7) / k END')} AS dl_drop_rate, CASE WHEN ue.u = 1 THEN -91.0 END::DOUBLE AS rsrp_dbm
FROM x, LATERAL (SELECT user_id::VARCHAR AS ue_id, 1 AS u UNION ALL SELECT 'x' || user_id, 2) ue""")
def native(spark, sf):
    b = base(spark, sf)
    s = lambda c: F.col(c).cast("string")
    ok = (F.col("k") - F.col("k") % 7).cast("string")
    nok = (F.col("k") % 7).cast("string")
    ue = lambda head, tail: F.concat(F.lit("{"), *head, F.lit(',"dl_brate":'), s("value"), F.lit(',"dl_nof_ok":'), ok, F.lit(',"dl_nof_nok":'), nok, *tail, F.lit("}"))
    line = F.concat(
        F.lit('{"timestamp":"2026-08-18T10:00:00Z","cells":[{"cell_metrics":{"pci":17},"ue_list":['), ue([F.lit('"rnti":'), s("user_id")], [F.lit(',"pci":9,"pusch_rsrp_db":-91.0')]), F.lit(","),
        ue([F.lit('"ue":"x'), s("user_id"), F.lit('"')], []), F.lit("]}]}"))
    got = tm.parse_native_scheduler(b.select("event_id", line.alias("value")), line_no="event_id", start_time_s=5.0, period_s=0.5)
    return got.select("event_id", "time_s", "ue_id", "cell_id", "dl_throughput_mbps", r6("dl_drop_rate").alias("dl_drop_rate"), "rsrp_dbm")


@query("telemetry_trace_columns", f"WITH {BASE} SELECT CASE WHEN event_id % 9 <> 0 THEN event_id::DOUBLE END AS time_s, user_id::VARCHAR AS ue_id, value AS sinr_db, CASE WHEN k > 1 THEN k / 100.0 ELSE k END::DOUBLE AS dl_drop_rate, CASE WHEN event_id % 9 = 0 THEN 'no_time' END AS problem FROM base")
def trace(spark, sf):
    s = lambda c: F.col(c).cast("string")
    rows = base(spark, sf).select(F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(s("event_id")).alias("simTime"), s("user_id").alias("IMSI"), s("value").alias("SINR"), s("k").alias("packetDropRate"))
    return tm.parse_trace(rows).select("time_s", "ue_id", "sinr_db", "dl_drop_rate", "problem")


def notes(spark, sf):
    """Documents as notes: front matter from their columns, two links appended to the text."""
    d = table(spark, sf, "documents")
    s = F.col("doc_id").cast("string")
    fm = F.concat(
        F.lit("---\nconcept_id: doc-"), s, F.lit("\nexcludes: ["), F.when(F.col("doc_id") % 3 == 0, "outage, night").otherwise(""), F.lit("]\nrequires_fidelity: "), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"),
        F.lit("\ndegraded_fidelity_edges:\n  - "), F.col("source"), F.lit("\n---\n"), F.col("text"), F.lit(" [["), F.col("lang"), F.lit("]] [["), F.col("source"), F.lit("]] [["), F.col("lang"), F.lit("]]"))
    return d.select(F.concat(F.lit("d/"), s).alias("path"), F.when(F.col("doc_id") % 50 == 7, F.col("text")).otherwise(fm).alias("value"), "doc_id")


NOTES = """nt AS (SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 50 <> 7 THEN 'doc-' || doc_id END AS concept_id, CASE WHEN doc_id % 50 <> 7 AND doc_id % 3 = 0 THEN ['outage', 'night'] ELSE [] END AS excludes, doc_id % 50 <> 7 AND doc_id % 2 = 0 AS requires_fidelity,
 CASE WHEN doc_id % 50 <> 7 THEN [source] ELSE [] END AS degraded, lang, source, length(text) AS n, CASE WHEN doc_id % 50 = 7 THEN 'no_front_matter' END AS problem FROM documents)"""


@query("notes_scan", f"WITH {NOTES} SELECT path, concept_id, excludes, requires_fidelity, degraded AS degraded_fidelity_edges, CASE WHEN problem IS NULL THEN [lang, source] END AS wikilinks, CASE WHEN problem IS NULL THEN n + length(' [[]] [[]] [[]]') + 2 * length(lang) + length(source) END AS body_length, problem FROM nt")
def scan(spark, sf):
    n = nt.parse_notes(notes(spark, sf))
    return n.select("path", "concept_id", "excludes", "requires_fidelity", "degraded_fidelity_edges", "wikilinks", F.length("body").cast("long").alias("body_length"), "problem")


@query("notes_duplicate_concepts", "SELECT 'c-' || (doc_id % 700) AS concept_id, count(*) AS notes FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, sf):
    d = table(spark, sf, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("---\nconcept_id: c-"), (F.col("doc_id") % 700).cast("string"), F.lit("\n---\n"), "text").alias("value"))
    return nt.duplicate_concepts(nt.parse_notes(files))


@query("notes_degraded_edges_union", f"WITH {NOTES} SELECT DISTINCT unnest(degraded) AS edge_name FROM nt")
def degraded(spark, sf):
    return nt.degraded_edges(nt.parse_notes(notes(spark, sf)))


@query("notes_page_links", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::BIGINT AS n_links, regexp_extract(html, 'href="([^"]+)"', 1) AS first_link FROM pages""")
def page_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", nt.links(F.col("html"), nt.HREF).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("n_links"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first_link"))


TASKS = """tk AS (SELECT o_orderkey, 'doc-' || (o_orderkey % 1200) AS task_kind, CASE WHEN o_orderkey % 4 = 0 THEN 'fresh' ELSE 'src' || (o_orderkey % 20) END AS edge_name, o_orderkey % 5 < 2 AS outage FROM orders)"""


@query("notes_admissibility", f"""WITH {NOTES}, {TASKS}, dg AS (SELECT DISTINCT unnest(degraded) AS e FROM nt)
SELECT o_orderkey, CASE WHEN c.concept_id IS NOT NULL THEN NOT (tk.edge_name IN (SELECT e FROM dg) AND (requires_fidelity OR (outage AND list_contains(excludes, 'outage')))) END AS admissible, CASE WHEN c.concept_id IS NULL THEN 'unknown_kind' END AS problem
FROM tk LEFT JOIN nt c ON c.concept_id = tk.task_kind""")
def admissible(spark, sf):
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("doc-"), (k % 1200).cast("string")).alias("task_kind"), F.when(k % 4 == 0, "fresh").otherwise(F.concat(F.lit("src"), (k % 20).cast("string"))).alias("edge_name"), (k % 5 < 2).alias("outage"))
    return nt.admissible(t, nt.parse_notes(notes(spark, sf))).select("o_orderkey", "admissible", "problem")


@query("notes_claim_notes", """SELECT 'claim-' || c_custkey || '-' || s AS concept_id, s AS status, length('---' || chr(10) || 'concept_id: claim-' || c_custkey || '-' || s || chr(10) || 'claim_status: ' || s || chr(10) || 'scenario: ' || c_custkey || chr(10) || 'excludes: []' || chr(10) || 'requires_fidelity: false' || chr(10) || '---' || chr(10) || chr(10) || '# Withheld / scored claim' || chr(10) || chr(10) || c_mktsegment || chr(10)) AS n
 FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'reject' ELSE 'outcome_unknown' END AS s FROM customer)""")
def claim_notes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("scenario"), F.when(F.col("c_custkey") % 2 == 0, "reject").otherwise("outcome_unknown").alias("status"), F.col("c_mktsegment").alias("reason"))
    return nt.claim_notes(c).select("concept_id", "status", F.length("value").cast("long").alias("n"))


@query("digest_documents", "SELECT doc_id, sha256(text) AS sha256, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def digest(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    # copies counted by digest with a map-side combine, then joined back
    n = d.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    return d.join(n, "sha256").select("doc_id", "sha256", "copies")


_PIECE = "sum(('0x' || substr(d, {0}, 13))::BIGINT::HUGEINT)::VARCHAR"


@query("digest_dataset_fingerprint", f"""WITH x AS (SELECT lang, sha256(concat_ws(chr(31), doc_id, source, text)) AS d FROM documents)
SELECT lang, count(*) AS rows, sha256(concat_ws('|', count(*), {_PIECE.format(1)}, {_PIECE.format(14)}, {_PIECE.format(27)}, {_PIECE.format(40)})) AS fingerprint FROM x GROUP BY lang""")
def fingerprint(spark, sf):
    return dg.dataset_fingerprint(table(spark, sf, "documents"), ["doc_id", "source", "text"], ["lang"])


@query("digest_freeze_drift", "SELECT 'input:customer' AS item UNION ALL SELECT 'seed'")
def freeze(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    before = dg.freeze_manifest(spark, {"seed": 1, "horizon": 22.0}, {"customer": c, "supplier": s})
    after = dg.freeze_manifest(spark, {"seed": 2, "horizon": 22.0}, {"customer": c.withColumn("c_acctbal", F.col("c_acctbal") + 1), "supplier": s})
    return dg.freeze_drift(before, after).select("item")


@query("trust_field_json_round_trip", f"WITH {EFFECTS}, {PRED}, {OBJ}, {CELLS} SELECT estimand, regime, alpha, CASE WHEN alpha = 1.0 THEN 'alpha_outside_grid' END AS problem FROM cells")
def json_round_trip(spark, sf):
    cells = tr.fit(errors(spark, sf), predictive(spark, sf))
    return io.cells_from_json(io.cells_to_json(cells), (0.0, 0.25, 0.5)).select("estimand", "regime", "alpha", "problem")


NS = "urn:example:"


def triple_lines(spark, sf):
    """Nations and suppliers as N-Triples lines, some of them broken."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("<urn:n:"), "n_nationkey", F.lit('> <urn:p:name> "'), "n_name", F.lit('" .')).alias("value"))
    s = table(spark, sf, "supplier")
    i = F.col("s_suppkey")
    r = s.select(F.when(i % 10 == 3, F.concat(F.lit("<urn:s:"), i, F.lit("> broken"))).otherwise(F.concat(F.lit("<urn:s:"), i, F.lit("> <urn:p:nation> <urn:n:"), "s_nationkey", F.lit("> ."))).alias("value"))
    b = s.select(F.concat(F.lit("<urn:s:"), i, F.lit('> <urn:p:balance> "'), F.col("s_acctbal").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#double> .')).alias("value"))
    return n.unionByName(r).unionByName(b)


@query("triples_read", """SELECT 'urn:n:' || n_nationkey AS s, 'urn:p:name' AS p, n_name AS o, 'literal' AS o_kind, 'http://www.w3.org/2001/XMLSchema#string' AS o_datatype, NULL AS problem FROM nation
 UNION ALL SELECT CASE WHEN s_suppkey % 10 <> 3 THEN 'urn:s:' || s_suppkey END, CASE WHEN s_suppkey % 10 <> 3 THEN 'urn:p:nation' END, CASE WHEN s_suppkey % 10 <> 3 THEN 'urn:n:' || s_nationkey END, CASE WHEN s_suppkey % 10 <> 3 THEN 'iri' END, NULL, CASE WHEN s_suppkey % 10 = 3 THEN 'not_a_triple' END FROM supplier
 UNION ALL SELECT 'urn:s:' || s_suppkey, 'urn:p:balance', s_acctbal::VARCHAR, 'literal', 'http://www.w3.org/2001/XMLSchema#double', NULL FROM supplier""")
def triples_read(spark, sf):
    return ad.parse_triples(triple_lines(spark, sf))


# --- through files in the shared folder --------------------------------------


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("files_run_table_csv", f"""WITH {RUNS} SELECT regime, scenario, replicate::INT AS replicate, model, policy, {q6('goal_utility_ratio')} AS goal_utility_ratio, events FROM runs""")
def run_table_csv(spark, sf):
    path = scratch(spark, "runs")
    rs.canonical_order(runs(spark, sf)).write.option("header", True).csv(path)
    got = rs.read_run_table(spark, path)
    return got.select("regime", "scenario", "replicate", "model", "policy", r6("goal_utility_ratio").alias("goal_utility_ratio"), "events")


@query("files_event_log", f"WITH {LOG} SELECT run_id, event_index, kind, true AS intact FROM log")
def event_log(spark, sf):
    path = scratch(spark, "log")
    lg = log(spark, sf).withColumn("run_group", F.col("run_id")).withColumn("run_id", F.col("run_id") % 8)
    io.write_event_log(lg, path)
    back = io.read_event_log(spark, path)
    return back.select(F.col("run_group").alias("run_id"), "event_index", "kind", "intact")


@query("files_graph_parquet", "SELECT 'Supply' AS edge_type, count(*) * 3 AS incidences FROM lineitem UNION ALL SELECT 'Placed', count(*) * 2 FROM orders")
def graph_parquet(spark, sf):
    path = scratch(spark, "graph")
    gr.write_graph(graph(spark, sf), path)
    inc = spark.read.parquet(f"{path}/incidences").filter(F.col("edge_type").isin("Supply", "Placed"))
    return inc.groupBy("edge_type").agg(F.count(F.lit(1)).alias("incidences"))


@query("files_kpm_jsonl", "SELECT count(*) FILTER (event_id % 6 <> 2) AS rows, count(*) FILTER (event_id % 6 IN (3, 4)) AS problems FROM events")
def kpm_jsonl(spark, sf):
    path = scratch(spark, "kpm")
    kpm_lines(spark, sf).select("value").write.text(path)
    return tm.read_kpm_jsonl(spark, path).agg(F.count(F.lit(1)).alias("rows"), F.count("problem").alias("problems"))


@query("files_checksums", "SELECT sha256(string_agg(text, chr(10) ORDER BY item_id) || chr(10)) AS sha256, 1 AS files FROM (SELECT item_id, item_id % 8 AS part, replace(text, chr(10), ' ') AS text FROM benchmark) GROUP BY part")
def checksums(spark, sf):
    """One file for each of eight parts of a table; every file's digest is compared."""
    path = scratch(spark, "texts")
    d = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 8).alias("part"), F.translate("text", "\n", " ").alias("value"))
    d.repartition("part").sortWithinPartitions("part", "item_id").select("part", "value").write.partitionBy("part").text(path)
    got = dg.checksum_files(spark, f"{path}/part=*/*.txt")
    return got.groupBy("sha256").agg(F.count(F.lit(1)).cast("int").alias("files"))
