"""Registered queries: proposal queues, shapes, previews, routes and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as ad
from ..operators import compose as cp
from .data import table
from .registry import query
from .tpch_graph import vid

NS = "urn:example:"
T, P = ad.RDF_TYPE, ad.PROV

MSG = """msg AS (SELECT conv_id || '-' || turn AS message_id, conv_id * 100 + turn AS seq, role AS source_owner, CASE WHEN turn = 0 THEN 'spawn' WHEN length(text) % 11 = 0 THEN 'attach_skill' WHEN length(text) % 13 = 0 THEN 'other' ELSE 'propose' END AS kind,
  (length(text) % 5)::INT AS priority, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 9 = 0 THEN 'user' WHEN conv_id % 9 = 1 THEN '' ELSE 'bot' || (conv_id % 40) END ELSE 'c' || conv_id || '-' || turn END AS name, CASE WHEN conv_id % 7 = 0 THEN 'nope' ELSE 'rule' || (turn % 2) END AS "constraint",
  CASE WHEN turn > 1 THEN ['c' || conv_id || '-' || (turn - 1)] ELSE [] END AS depends_on, CASE WHEN length(text) % 17 <> 0 THEN md5(text) END AS artifact_hash, CASE WHEN turn % 4 = 3 THEN 'suite' ELSE 'payload' END AS artifact_source, conv_id, turn FROM conversations)"""


def messages(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.length("text")
    name = lambda t: F.concat(F.lit("c"), "conv_id", F.lit("-"), t)
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("role").alias("source_owner"),
        F.when(F.col("turn") == 0, "spawn").when(n % 11 == 0, "attach_skill").when(n % 13 == 0, "other").otherwise("propose").alias("kind"), (n % 5).alias("priority"),
        F.when(F.col("turn") == 0, F.when(F.col("conv_id") % 9 == 0, "user").when(F.col("conv_id") % 9 == 1, "").otherwise(F.concat(F.lit("bot"), F.col("conv_id") % 40))).otherwise(name(F.col("turn"))).alias("name"),
        F.when(F.col("conv_id") % 7 == 0, "nope").otherwise(F.concat(F.lit("rule"), F.col("turn") % 2)).alias("constraint"),
        F.when(F.col("turn") > 1, F.array(name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        F.when(n % 17 != 0, F.md5("text")).alias("artifact_hash"), F.when(F.col("turn") % 4 == 3, "suite").otherwise("payload").alias("artifact_source"))


def facts(spark, sf):
    c = table(spark, sf, "conversations")
    owners = c.filter("role <> 'system'").select(F.col("role").alias("owner")).distinct()
    components = c.filter("turn = 1 AND conv_id % 10 = 5").select(F.concat(F.lit("c"), "conv_id", F.lit("-1")).alias("name"))
    concepts = c.select((F.col("turn") % 2).alias("x")).distinct().select(F.concat(F.lit("rule"), "x").alias("concept_id"), (F.col("x") == 1).alias("requires_fidelity"))
    m = F.col("conv_id") % 8
    fid = c.filter("conv_id % 8 <> 0").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("name"), (m != 1).alias("passed"), F.when(m == 2, "old").otherwise(F.md5("text")).alias("suite_hash"), F.lit(0).alias("exit_code"),
        F.when(m == 3, "timeout").otherwise("pass").alias("outcome"))
    return owners, components, concepts, fid


FACTS = """own AS (SELECT DISTINCT role AS owner FROM conversations WHERE role <> 'system'), comp AS (SELECT 'c' || conv_id || '-1' AS name FROM conversations WHERE turn = 1 AND conv_id % 10 = 5),
 fid AS (SELECT 'c' || conv_id || '-' || turn AS name, conv_id % 8 <> 1 AS passed, CASE WHEN conv_id % 8 = 2 THEN 'old' ELSE md5(text) END AS sh, CASE WHEN conv_id % 8 = 3 THEN 'timeout' ELSE 'pass' END AS oc FROM conversations WHERE conv_id % 8 <> 0),
 fr AS (SELECT m.*, CASE WHEN artifact_hash IS NULL OR sh IS NULL THEN 'runner_absent' WHEN sh <> artifact_hash THEN 'stale_fidelity' WHEN oc = 'timeout' THEN 'runner_timeout' WHEN NOT passed THEN 'runner_failed' ELSE 'runner_passed' END AS fr FROM msg m LEFT JOIN fid USING (name))"""
VERDICT = """CASE WHEN source_owner NOT IN (SELECT owner FROM own) THEN 'reject:unknown_owner' WHEN kind = 'spawn' AND name = '' THEN 'outcome_unknown:missing_name' WHEN kind = 'spawn' AND name IN (SELECT owner FROM own) THEN 'reject:duplicate_owner'
  WHEN kind = 'spawn' THEN 'admit:owner_registered' WHEN kind = 'attach_skill' THEN 'reject:use_attach_skill_tool' WHEN kind <> 'propose' THEN 'outcome_unknown:unsupported_kind' WHEN "constraint" = 'nope' THEN 'outcome_unknown:unknown_constraint'
  WHEN artifact_hash IS NULL THEN 'outcome_unknown:missing_artifact' WHEN artifact_source = 'suite' AND "constraint" = 'rule0' THEN 'reject:suite_requires_fidelity' WHEN name IN (SELECT name FROM {comp}) THEN 'reject:duplicate_component'
  WHEN len(list_filter(depends_on, lambda d: d NOT IN (SELECT name FROM {comp}))) > 0 THEN 'hold_unresolved:missing_dependency' WHEN fr = 'runner_timeout' THEN 'outcome_unknown:runner_timeout'
  WHEN fr = 'runner_failed' OR ("constraint" = 'rule1' AND fr <> 'runner_passed') THEN 'reject:' || fr ELSE 'admit:vault_legal' END"""
VERDICT = VERDICT.replace("len(list_filter(depends_on, lambda d: d NOT IN (SELECT name FROM {comp}))) > 0", "(turn > 1 AND ('c' || conv_id || '-' || (turn - 1)) NOT IN (SELECT name FROM {comp}))")
DUP = "CASE WHEN v = 'admit:owner_registered' AND row_number() OVER (PARTITION BY v, kind, name ORDER BY -priority, seq, message_id) > 1 THEN 'reject:duplicate_owner' ELSE v END"


@query("admission_drain_order", f"WITH {MSG} SELECT message_id, row_number() OVER (ORDER BY priority DESC, seq) AS position FROM msg")
def drain(spark, sf):
    return ad.drain_order(messages(spark, sf)).select("message_id", "position")


@query("admission_classify", f"WITH {MSG}, {FACTS}, x AS (SELECT *, {VERDICT.format(comp='comp')} AS v FROM fr), y AS (SELECT message_id, {DUP} AS v FROM x) SELECT message_id, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason FROM y")
def classify(spark, sf):
    return ad.classify(messages(spark, sf), *facts(spark, sf)).select("message_id", "status", "reason")


@query("admission_missing_dependencies", f"WITH {MSG}, {FACTS} SELECT message_id, depends_on AS missing FROM msg WHERE turn > 1 AND ('c' || conv_id || '-' || (turn - 1)) NOT IN (SELECT name FROM comp)")
def missing(spark, sf):
    return ad.missing_dependencies(messages(spark, sf), facts(spark, sf)[1])


@query("admission_fidelity_reasons", f"WITH {MSG}, {FACTS} SELECT message_id, fr AS fidelity_reason FROM fr")
def fidelity(spark, sf):
    return ad.fidelity_reason(messages(spark, sf), facts(spark, sf)[3]).select("message_id", "fidelity_reason")


# a proposal depends on the previous turn, so admission runs up each conversation turn by turn
@query("admission_resolve_dependencies", f"""WITH RECURSIVE {MSG}, {FACTS}, self AS (SELECT *, {VERDICT.format(comp='comp')} AS v0, {VERDICT.format(comp="(SELECT name FROM comp UNION ALL SELECT 'c' || conv_id || '-' || (turn - 1) AS name)").replace("name IN (SELECT name FROM (SELECT name FROM comp UNION ALL SELECT 'c' || conv_id || '-' || (turn - 1) AS name))", "name IN (SELECT name FROM comp)").replace("('c' || conv_id || '-' || (turn - 1)) NOT IN (SELECT name FROM (SELECT name FROM comp UNION ALL SELECT 'c' || conv_id || '-' || (turn - 1) AS name))", "false")} AS v1 FROM fr),
 adm(name) AS (SELECT name FROM self WHERE kind = 'propose' AND v0 = 'admit:vault_legal' UNION SELECT s.name FROM self s JOIN adm ON adm.name = s.depends_on[1] WHERE s.kind = 'propose' AND v1 = 'admit:vault_legal'),
 z AS (SELECT *, CASE WHEN v0 <> 'hold_unresolved:missing_dependency' THEN v0 WHEN depends_on[1] IN (SELECT name FROM adm) THEN v1 ELSE v0 END AS v FROM self), y AS (SELECT message_id, {DUP} AS v FROM z)
SELECT message_id, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason FROM y""")
def resolve(spark, sf):
    return ad.resolve_dependencies(messages(spark, sf), *facts(spark, sf)).select("message_id", "status", "reason")


@query("admission_payload_names", """SELECT doc_id, CASE WHEN NOT regexp_full_match(n, '[a-z0-9]([a-z0-9._-]{0,126}[a-z0-9])?') OR split_part(n, '.', 1) IN ('con', 'nul', 'com1') THEN 'invalid_component_name' WHEN doc_id % 5 = 0 THEN 'invalid_constraint' WHEN doc_id % 7 = 0 THEN 'incomplete_artifact' END AS problem
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '.' || source WHEN 1 THEN upper(lang) WHEN 2 THEN 'con.' || lang ELSE lang || '-' END AS n FROM documents)""")
def names(spark, sf):
    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 4
    name = F.when(m == 0, F.concat_ws(".", "lang", "source")).when(m == 1, F.upper("lang")).when(m == 2, F.concat(F.lit("con."), "lang")).otherwise(F.concat("lang", F.lit("-")))
    con = F.when(F.col("doc_id") % 5 == 0, "").otherwise("rule")
    p = ad.payload_problem(name, con, F.array(F.col("lang")), F.when(F.col("doc_id") % 7 != 0, F.lit("m")), F.lit("t"))
    return d.select("doc_id", p.alias("problem"))


# --- triples -----------------------------------------------------------------


def triples(spark, sf):
    """Nations are cells, their suppliers components, parts are proposals to a nation."""
    s, p, n = table(spark, sf, "supplier"), table(spark, sf, "part"), table(spark, sf, "nation")
    # a part takes a few bytes in its file and many as triples: the rows are dealt out before they grow, not read as one block
    p = p.repartition("p_partkey")
    X = ad.XSD + "string"
    t = lambda s_, p_, o, kind, dt=None: F.struct(s_.alias("s"), F.lit(p_).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_datatype"))
    lit = lambda x: F.lit(x)
    sup, cell, prt = vid("urn:s", "s_suppkey"), vid("urn:n", "s_nationkey"), vid("urn:p", "p_partkey")
    a = s.select(F.inline(F.array(
        t(sup, T, lit(NS + "Component"), "iri"), t(sup, T, lit(P + "Entity"), "iri"), t(sup, NS + "name", F.col("s_name"), "literal", X),
        t(sup, NS + "moduleDigest", F.when(F.col("s_suppkey") % 6 == 0, "short").otherwise(F.sha2("s_name", 256)), "literal", X), t(cell, P + "hadMember", sup, "iri"))))
    b = n.select(F.inline(F.array(t(vid("urn:n", "n_nationkey"), T, lit(NS + "Cell"), "iri"), t(vid("urn:n", "n_nationkey"), NS + "revision", F.col("n_name"), "literal", X))))
    k = F.col("p_partkey")
    c = p.select(F.inline(F.array(
        t(prt, T, lit(NS + "Proposal"), "iri"), t(prt, NS + "name", F.when(k % 9 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 100).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("part"), k)), "literal", X),
        t(prt, NS + "component", F.when(k % 11 == 0, F.concat(F.lit("urn:s:"), k % 10)).otherwise(vid("urn:c", "p_partkey")), "iri"),
        t(prt, NS + "moduleDigest", F.sha2("p_name", 256), "literal", X), t(prt, NS + "evidenceDigest", F.sha2("p_brand", 256), "literal", X), t(prt, NS + "dependsOn", F.concat(F.lit("urn:s:"), k % 100), "iri"))))
    return a.unionByName(b).unionByName(c)


SHAPES = [
    ("component", NS + "Component", NS + "name", 1, 1, ad.XSD + "string", None, 1, None, None, None), ("component", NS + "Component", NS + "moduleDigest", 1, 1, ad.XSD + "string", "^[0-9a-f]{64}$", None, None, None, None),
    ("cell", NS + "Cell", P + "hadMember", None, None, None, None, None, None, "iri", NS + "Component"), ("cell", NS + "Cell", NS + "revision", 1, 1, ad.XSD + "string", None, 1, "NATION_1", None, None),
    ("proposal", NS + "Proposal", NS + "dependsOn", None, None, None, None, None, None, "iri", NS + "Component"),
]
SHAPE_SCHEMA = "shape STRING, target_class STRING, path STRING, min_count INT, max_count INT, datatype STRING, pattern STRING, min_length INT, has_value STRING, node_kind STRING, value_class STRING"


@query("triples_shape_check", f"""SELECT 'urn:s:' || s_suppkey AS focus, 'component' AS shape, '{NS}moduleDigest' AS path, 'pattern' AS code FROM supplier WHERE s_suppkey % 6 = 0
 UNION ALL SELECT 'urn:n:' || n_nationkey, 'cell', '{NS}revision', 'has_value' FROM nation WHERE n_name <> 'NATION_1'
 UNION ALL SELECT 'urn:p:' || p_partkey, 'proposal', '{NS}dependsOn', 'class' FROM part WHERE p_partkey % 100 NOT IN (SELECT s_suppkey FROM supplier)""")
def shapes(spark, sf):
    return ad.shape_check(triples(spark, sf), spark.createDataFrame(SHAPES, SHAPE_SCHEMA))


PREV = """pv AS (SELECT p_partkey AS k, 'urn:p:' || p_partkey AS proposal, p_partkey % 25 AS nk, CASE WHEN p_partkey % 9 = 0 THEN 'Supplier#' || lpad((p_partkey % 100)::VARCHAR, 9, '0') ELSE 'part' || p_partkey END AS name FROM part),
 jd AS (SELECT pv.*, CASE WHEN k % 13 = 0 THEN 'evidence digest mismatch' WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k % 100 AND s_nationkey = nk) THEN 'dependency is not a member'
   WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = nk AND s_name = pv.name) THEN 'name is taken' WHEN k % 11 = 0 THEN 'component identifier is in use' END AS problem FROM pv)"""


def preview(spark, sf):
    p = table(spark, sf, "part").repartition("p_partkey")
    k = F.col("p_partkey")
    props = p.select(vid("urn:p", "p_partkey").alias("proposal"), F.concat(F.lit("urn:n:"), k % 25).alias("cell"))
    content = p.select(vid("urn:p", "p_partkey").alias("proposal"), F.sha2("p_name", 256).alias("module_sha256"), F.when(k % 13 == 0, "x").otherwise(F.sha2("p_brand", 256)).alias("evidence_sha256"))
    return ad.admission_preview(triples(spark, sf), props, content, NS)


# names repeat between proposals only where they repeat a supplier's, which "dependency" or "taken" already refuse
@query("triples_admission_preview", f"""WITH {PREV}, f AS (SELECT nk, name, min(proposal) AS first FROM pv GROUP BY ALL) SELECT proposal, 'urn:n:' || nk AS cell, coalesce(problem, CASE WHEN first <> proposal THEN 'name is proposed twice' END) AS problem, coalesce(problem, CASE WHEN first <> proposal THEN 'x' END) IS NULL AS has_receipt FROM jd JOIN f USING (nk, name)""")
def admission_preview(spark, sf):
    return preview(spark, sf)[0].select("proposal", "cell", "problem", F.col("receipt").isNotNull().alias("has_receipt"))


@query("triples_admission_new", f"WITH {PREV}, f AS (SELECT nk, name, min(proposal) AS first FROM pv GROUP BY ALL), ok AS (SELECT jd.* FROM jd JOIN f USING (nk, name) WHERE problem IS NULL AND first = proposal) SELECT 'urn:c:' || k AS s, 6::BIGINT - 1 AS own_triples, 'urn:n:' || nk AS cell FROM ok")
def new_triples(spark, sf):
    t = preview(spark, sf)[1]
    own = t.filter(F.col("p") != P + "hadMember").groupBy("s").agg(F.count(F.lit(1)).alias("own_triples"))
    return own.join(t.filter(F.col("p") == P + "hadMember").select(F.col("o").alias("s"), F.col("s").alias("cell")), "s")


@query("triples_provenance", f"WITH {PREV}, f AS (SELECT nk, name, min(proposal) AS first FROM pv GROUP BY ALL), ok AS (SELECT count(*) AS n FROM jd JOIN f USING (nk, name) WHERE problem IS NULL AND first = proposal) SELECT p, n * m AS n FROM ok, (VALUES ('{T}', 3), ('{P}used', 3), ('{P}wasGeneratedBy', 1), ('{P}wasDerivedFrom', 1)) x(p, m)")
def provenance(spark, sf):
    return ad.provenance_triples(preview(spark, sf)[0]).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def route_triples(spark, sf):
    """Nations are sites; order lines become routes between customer and supplier nations, one per order."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    r, iri = vid("urn:r", "o_orderkey"), lambda x: F.concat(F.lit("urn:n:"), x)
    t = lambda s_, p_, o_: F.struct(s_.alias("s"), F.lit(p_).alias("p"), o_.cast("string").alias("o"))
    rows = F.array(t(r, T, F.lit(NS + "Route")), t(r, NS + "source", iri(F.col("c_nationkey"))), t(r, NS + "target", iri((F.col("c_nationkey") + k) % 25)), t(r, NS + "up", F.when(F.col("o_orderstatus") == "P", "maybe").otherwise((F.col("o_orderstatus") == "F").cast("string"))),
                   t(r, NS + "failureRate", F.lit("0.5")), t(r, NS + "repairRate", F.when(k % 40 == 1, "-1").otherwise("0.25")), t(r, NS + "extra", F.when(k % 30 == 2, "x")))
    n = table(spark, sf, "nation").select(vid("urn:n", "n_nationkey").alias("s"), F.lit(T).alias("p"), F.lit(NS + "Site").alias("o"))
    return n.unionByName(j.select(F.inline(rows)).filter("o IS NOT NULL"))


@query("triples_project_routes", """SELECT 'urn:r:' || o_orderkey AS route, o_orderstatus = 'F' AS up, CASE WHEN (c_nationkey + o_orderkey) % 25 = c_nationkey THEN 'bad endpoints' WHEN o_orderstatus = 'P' THEN 'up is not a boolean' WHEN o_orderkey % 40 = 1 THEN 'bad rate' END AS problem FROM orders JOIN customer ON o_custkey = c_custkey""")
def routes(spark, sf):
    return ad.project_routes(route_triples(spark, sf), NS).select("route", "up", "problem")


@query("triples_unsupported", f"SELECT 'urn:r:' || o_orderkey AS s, '{NS}extra' AS p, 'x' AS o, 'unknown_property' AS code FROM orders WHERE o_orderkey % 30 = 2")
def unsupported(spark, sf):
    return ad.unsupported_triples(route_triples(spark, sf), NS)


@query("triples_state_disagreements", """SELECT 'urn:r:' || o_orderkey AS route, CASE WHEN o_orderstatus = 'F' THEN 'missing_edge' ELSE 'unexpected_edge' END AS side FROM orders WHERE (o_orderstatus = 'F' AND o_orderkey % 8 = 0) OR (o_orderstatus <> 'F' AND o_orderkey % 8 = 1)""")
def state(spark, sf):
    r = ad.project_routes(route_triples(spark, sf), NS)
    k = F.substring("route", 7, 20).cast("long") % 8
    return ad.state_disagreements(r.filter((F.col("up") & (k != 0)) | (~F.col("up") & (k == 1))), r).select("route", "side")


# --- composition -------------------------------------------------------------


def parts_of(spark, sf):
    """Orders and customers as two components wired through their shared customers and dates."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    vo = o.select(F.lit("orders").alias("component"), vid("O", "o_orderkey").alias("vertex_id"), F.lit("Order").alias("type_id"), F.col("o_orderstatus").alias("tag"))
    vc = c.select(F.lit("customers").alias("component"), vid("C", "c_custkey").alias("vertex_id"), F.lit("Any").alias("type_id"), F.lit("F").alias("tag"))
    ho = o.select(F.lit("orders").alias("component"), vid("h", "o_orderkey").alias("handle_id"), F.when(F.col("o_orderkey") % 20 == 0, "input").otherwise("output").alias("direction"), vid("O", "o_orderkey").alias("binding"))
    hc = c.select(F.lit("customers").alias("component"), vid("k", "c_custkey").alias("handle_id"), F.lit("input").alias("direction"), F.when(F.col("c_custkey") % 15 != 0, vid("C", "c_custkey")).alias("binding"))
    w = o.select(F.lit("orders").alias("left_component"), vid("h", "o_orderkey").alias("left_handle"), F.lit("customers").alias("right_component"), vid("k", "o_custkey").alias("right_handle"))
    closure = spark.createDataFrame([("Order", "Order"), ("Order", "Any"), ("Any", "Any")], "type_id STRING, ancestor STRING")
    return vo.unionByName(vc), w, ho.unionByName(hc), closure


W = """w AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_custkey % 15 = 0 THEN 'unbound_handle' WHEN o_orderkey % 20 = 0 THEN 'incompatible_directions' END AS problem FROM orders),
 g AS (SELECT o_custkey, count(*) AS n, bool_and(o_orderstatus = 'F') AS same FROM w WHERE problem IS NULL GROUP BY o_custkey)"""


@query("compose_wire_pairs", f"WITH {W} SELECT 'h:' || o_orderkey AS left_handle, 'k:' || o_custkey AS right_handle, problem FROM w")
def wires(spark, sf):
    v, w, h, cl = parts_of(spark, sf)
    return cp.wire_pairs(w, h, v, cl).select("left_handle", "right_handle", "problem")


@query("compose_vertices", f"""WITH {W} SELECT 'customers::C:' || c_custkey AS root, CASE WHEN n IS NULL THEN 'Any' ELSE 'Order' END AS type_id, 1 + coalesce(n, 0) AS members FROM customer LEFT JOIN g ON c_custkey = o_custkey
 UNION ALL SELECT 'orders::O:' || o_orderkey, 'Order', 1 FROM w WHERE problem IS NOT NULL""")
def composed(spark, sf):
    v, w, h, cl = parts_of(spark, sf)
    return cp.compose(v, w, h, cl, ["tag"], {"Any": 1, "Order": 2})["vertices"].select("root", "type_id", "members")


@query("compose_conflicts", f"WITH {W} SELECT 'customers::C:' || o_custkey AS root, 'tag' AS attribute FROM g WHERE NOT same")
def conflicts(spark, sf):
    v, w, h, cl = parts_of(spark, sf)
    return cp.compose(v, w, h, cl, ["tag"], {"Any": 1, "Order": 2})["conflicts"]


@query("compose_remaining_handles", "SELECT 'customers::k:' || c_custkey AS handle_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0) UNION ALL SELECT 'orders::h:' || o_orderkey FROM orders WHERE o_custkey % 3 <> 0")
def handles(spark, sf):
    v, w, h, cl = parts_of(spark, sf)
    w = w.filter(F.substring("right_handle", 3, 20).cast("long") % 3 == 0)
    return cp.remaining_handles(h, w, v.withColumn("root", F.col("vertex_id"))).select("handle_id")


@query("compose_remap_endpoints", "SELECT 'O:' || o_orderkey AS edge_id, 'new-' || o_custkey AS tail FROM orders")
def remap(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    e = o.select(F.lit("customers").alias("component"), vid("O", "o_orderkey").alias("edge_id"), vid("C", "o_custkey").alias("tail"))
    m = c.select(F.lit("customers").alias("component"), vid("C", "c_custkey").alias("vertex_id"), F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("root"))
    return cp.remap_endpoints(e, ["tail"], m).select("edge_id", "tail")


@query("compose_connected_components", """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS a, l_partkey + 100000000 AS b FROM lineitem),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(node, m) USING KEY (node) AS (SELECT a, a FROM e UNION SELECT e.b, min(r.m) FROM r JOIN e ON r.node = e.a JOIN recurring.r AS c ON c.node = e.b WHERE r.m < c.m GROUP BY e.b) SELECT node, m AS root FROM r""")
def components(spark, sf):
    li = table(spark, sf, "lineitem")
    l = li.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 100000000).alias("b"))
    return cp.connected_components(None, l)
