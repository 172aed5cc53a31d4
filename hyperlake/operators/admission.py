"""Proposal queues: ordering, legality, dependencies and verification facts."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ordered
from ..session import cut
from .match import one_sided

# fixed values: name forms and reserved device names
COMPONENT_NAME = "^[a-z0-9](?:[a-z0-9._-]{0,126}[a-z0-9])?$"
OWNER_NAME = "^[A-Za-z0-9](?:[A-Za-z0-9._-]{0,126}[A-Za-z0-9])?$"
DEVICE_NAMES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
# fixed values: verification outcomes that leave a proposal undecided
UNDECIDED = {
    "sandbox_required": "runner_sandbox_required", "timeout": "runner_timeout", "infra_error": "runner_infrastructure",
    "output_limit": "runner_output_limit", "cleanup_failed": "runner_cleanup_failed",
}
SPAWN, PROPOSE, ATTACH = "spawn", "propose", "attach_skill"


def drain_order(messages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``position``: priority descending, then sequence."""
    m = messages.withColumn("_p", -F.col("priority"))
    got = ordered.scan(m, keys, ["_p", "seq"], {"position": ordered.rnumber()})
    return got.drop("_p")


def valid_component_name(name: Column) -> Column:
    return F.coalesce(name.rlike(COMPONENT_NAME) & ~F.element_at(F.split(name, r"\."), 1).isin(*DEVICE_NAMES), F.lit(False))


def payload_problem(name: Column, constraint: Column, depends_on: Column, module: Column, tests: Column) -> Column:
    """First reason a proposal's payload is malformed, or null."""
    blank = lambda c: F.trim(c) == ""
    return (
        F.when(~valid_component_name(name), "invalid_component_name").when(constraint.isNull() | (constraint == ""), "invalid_constraint")
        .when(F.exists(F.coalesce(depends_on, F.array().cast("array<string>")), lambda d: ~valid_component_name(d)), "invalid_dependencies")
        .when(module.isNull() != tests.isNull(), "incomplete_artifact").when(module.isNotNull() & (blank(module) | blank(tests)), "invalid_artifact")
    )


def missing_dependencies(messages: DataFrame, components: DataFrame) -> DataFrame:
    """message_id and the dependencies that are not among the components."""
    need = messages.select("message_id", F.explode("depends_on").alias("name"))
    gone = need.join(components.select("name").distinct(), "name", "left_anti")
    # a message's own dependency list, so the group is as small as the message
    return gone.groupBy("message_id").agg(F.array_sort(F.collect_set("name")).alias("missing"))


def fidelity_reason(messages: DataFrame, fidelity: DataFrame) -> DataFrame:
    """Verification of each message's artifact: runner_passed or why not.

    Of several facts of one name the worst counts (undecided, then failed, then passed), of equal ones the one with the
    greater suite hash, so that a message gets one reason whatever the order of the rows.
    """
    failed = ~F.coalesce("passed", F.lit(False)) | ~F.col("outcome").eqNullSafe(F.lit("pass")) | ~F.col("exit_code").eqNullSafe(F.lit(0))
    badness = F.when(F.col("outcome").isin(*UNDECIDED), 2).when(failed, 1).otherwise(0)
    facts = F.struct(badness.alias("badness"), "suite_hash", "outcome", "exit_code", "passed")
    f = fidelity.groupBy("name").agg(F.max(facts).alias("f")).select("name", "f.passed", "f.suite_hash", "f.exit_code", "f.outcome")
    j = messages.join(f, "name", "left")
    outcome = F.create_map(*[x for k, v in UNDECIDED.items() for x in (F.lit(k), F.lit(v))])[F.col("outcome")]
    reason = (
        F.when(F.col("artifact_hash").isNull() | F.col("suite_hash").isNull(), "runner_absent").when(F.col("suite_hash") != F.col("artifact_hash"), "stale_fidelity")
        .when(outcome.isNotNull(), outcome).when(~F.col("passed") | (F.col("outcome") != "pass") | (F.col("exit_code") != 0), "runner_failed").otherwise("runner_passed")
    )
    return j.withColumn("fidelity_reason", reason).drop("passed", "suite_hash", "exit_code", "outcome")


def classify(messages: DataFrame, owners: DataFrame, components: DataFrame, concepts: DataFrame, fidelity: DataFrame, reserved: Sequence[str] = ()) -> DataFrame:
    """Status and reason of every message against the given facts; legality before priority.

    messages: message_id, seq, source_owner, kind, priority, name, constraint,
    depends_on, artifact_hash, artifact_source.  Of several messages that would
    register one name the first in drain order counts, the others are duplicates.
    """
    m = messages.join(owners.select(F.col("owner").alias("source_owner"), F.lit(True).alias("_own")).distinct(), "source_owner", "left")
    m = m.join(owners.select(F.col("owner").alias("name"), F.lit(True).alias("_taken")).distinct(), "name", "left")
    m = m.join(components.select("name", F.lit(True).alias("_exists")).distinct(), "name", "left")
    # a concept given twice is known once and asks for what any of its rows asks for
    single = concepts.groupBy(F.col("concept_id").alias("constraint")).agg(F.bool_or("requires_fidelity").alias("_rf"), F.lit(True).alias("_known"))
    m = m.join(single, "constraint", "left")
    m = fidelity_reason(m, fidelity).join(missing_dependencies(messages, components), "message_id", "left")
    k = F.col("kind")
    fr = F.col("fidelity_reason")
    blank = F.col("name").isNull() | (F.col("name") == "")
    pair = lambda s, r: F.struct(F.lit(s).alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    undecided = fr.isin(*UNDECIDED.values())
    verdict = (
        F.when(F.col("_own").isNull(), pair("reject", "unknown_owner"))
        .when((k == SPAWN) & blank, pair("outcome_unknown", "missing_name")).when((k == SPAWN) & F.col("_taken"), pair("reject", "duplicate_owner")).when(k == SPAWN, pair("admit", "owner_registered"))
        .when(k == ATTACH, pair("reject", "use_attach_skill_tool")).when(k != PROPOSE, pair("outcome_unknown", "unsupported_kind"))
        .when(F.col("_known").isNull(), pair("outcome_unknown", "unknown_constraint")).when(blank, pair("outcome_unknown", "missing_name"))
        .when(F.col("artifact_hash").isNull(), pair("outcome_unknown", "missing_artifact"))
        .when((F.col("artifact_source") == "payload") & F.col("name").isin(*(reserved or ("",))), pair("reject", "reserved_component_name"))
        .when((F.col("artifact_source") == "suite") & ~F.col("_rf"), pair("reject", "suite_requires_fidelity"))
        .when(F.col("_exists"), pair("reject", "duplicate_component")).when(F.col("missing").isNotNull(), pair("hold_unresolved", "missing_dependency"))
        .when(undecided, pair("outcome_unknown", fr)).when((fr == "runner_failed") | (F.col("_rf") & (fr != "runner_passed")), pair("reject", fr))
        .otherwise(pair("admit", "vault_legal"))
    )
    got = m.withColumn("_v", verdict).withColumns({"status": F.col("_v.status"), "reason": F.col("_v.reason")})
    # the earliest admissible message of a name, by an aggregate rather than a window over a hot name
    first = got.filter("status = 'admit'").groupBy("kind", "name").agg(F.min(F.struct((-F.col("priority")).alias("p"), "seq", "message_id")).alias("_f"))
    got = got.join(first, ["kind", "name"], "left")
    late = (F.col("status") == "admit") & (F.col("_f.message_id") != F.col("message_id"))
    return got.select(
        *messages.columns, F.when(late, "reject").otherwise(F.col("status")).alias("status"),
        F.when(late & (k == SPAWN), "duplicate_owner").when(late, "duplicate_component").otherwise(F.col("reason")).alias("reason"), "missing",
    )


def resolve_dependencies(messages: DataFrame, owners: DataFrame, components: DataFrame, concepts: DataFrame, fidelity: DataFrame, reserved: Sequence[str] = ()) -> DataFrame:
    """Re-classify held proposals as their dependencies are admitted, to a fixpoint.

    Rounds are bounded by the longest dependency chain; each round only carries
    the messages still held.
    """
    open_ = cut(messages)
    known = components.select("name").distinct()
    done = None
    for round_no in itertools.count():
        now = cut(classify(open_, owners, known, concepts, fidelity, reserved).withColumn("round", F.lit(round_no)))
        held = now.filter("status = 'hold_unresolved'")
        fresh = now.filter(f"status = 'admit' AND kind = '{PROPOSE}'").select("name")
        settled = now.filter("status <> 'hold_unresolved'")
        done = settled if done is None else done.unionByName(settled)
        if fresh.isEmpty() or held.isEmpty():
            return done.unionByName(held)
        known = cut(known.unionByName(fresh).distinct())
        open_ = held.select(*messages.columns)


# --- triples -----------------------------------------------------------------

# fixed values: vocabulary terms
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PROV = "http://www.w3.org/ns/prov#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def shape_check(triples: DataFrame, constraints: DataFrame) -> DataFrame:
    """Violations (focus, shape, path, code) of declared property constraints.

    ``constraints`` is a catalogue table: shape, target_class, path, min_count,
    max_count, datatype, pattern, min_length, has_value, node_kind, value_class;
    unused columns are null.
    """
    types = triples.filter(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("cls"))
    focus = types.withColumnRenamed("cls", "target_class").join(F.broadcast(constraints), "target_class").withColumnRenamed("path", "p")
    paths = constraints.select(F.col("path").alias("p")).distinct()
    vals = triples.select("s", "p", "o", "o_kind", "o_datatype").join(F.broadcast(paths), "p", "left_semi")
    # triples compress so well that by the size of their files or shuffle all subjects would be broadcast, so joins are told to sort
    v = focus.join(vals.hint("merge"), ["s", "p"], "left")
    # only classes that a constraint asks for
    asked = constraints.select(F.col("value_class").alias("cls")).filter("cls IS NOT NULL").distinct()
    is_a = types.join(F.broadcast(asked), "cls", "left_semi").select(F.col("s").alias("o"), F.col("cls").alias("value_class"), F.lit(True).alias("_isa")).distinct()
    v = v.join(is_a.hint("merge"), ["o", "value_class"], "left")
    has = F.col("o").isNotNull()
    bad = lambda need, test: F.count_if(has & F.col(need).isNotNull() & test)
    per = v.groupBy("s", "shape", "p").agg(
        F.count("o").alias("n"), F.first("min_count").alias("lo"), F.first("max_count").alias("hi"),
        bad("datatype", ~F.col("o_datatype").eqNullSafe(F.col("datatype"))).alias("datatype_violations"),
        bad("pattern", ~F.regexp_like("o", F.col("pattern"))).alias("pattern_violations"),
        bad("min_length", F.length("o") < F.col("min_length")).alias("min_length_violations"),
        F.when(F.first("has_value").isNotNull() & (F.count_if(F.col("o") == F.col("has_value")) == 0), 1).otherwise(0).alias("has_value_violations"),
        bad("node_kind", F.col("o_kind") != F.col("node_kind")).alias("node_kind_violations"),
        bad("value_class", F.col("_isa").isNull()).alias("class_violations"),
    )
    codes = [F.when(F.col("n") < F.col("lo"), F.lit("min_count")), F.when(F.col("n") > F.col("hi"), F.lit("max_count"))]
    codes += [F.when(F.col(f"{c}_violations") > 0, F.lit(c)) for c in ("datatype", "pattern", "min_length", "has_value", "node_kind", "class")]
    return per.select(F.col("s").alias("focus"), "shape", F.col("p").alias("path"), F.explode(F.filter(F.array(*codes), lambda x: x.isNotNull())).alias("code"))


def pivot_properties(triples: DataFrame, properties: Mapping[str, str], subjects: DataFrame | None = None) -> DataFrame:
    """One row per subject with the named properties; ``problem`` where one is not single-valued."""
    aggs = []
    for name, p in properties.items():
        aggs += [F.max(F.when(F.col("p") == p, F.col("o"))).alias(name), F.count_if(F.col("p") == p).alias(f"_n_{name}")]
    t = triples if subjects is None else triples.join(subjects.select("s"), "s", "left_semi")
    got = t.groupBy("s").agg(*aggs)
    off = F.filter(F.array(*[F.when(F.col(f"_n_{n}") != 1, F.lit(n)) for n in properties]), lambda x: x.isNotNull())
    return got.withColumn("problem", F.when(F.size(off) > 0, F.concat(F.lit("not single-valued: "), F.array_join(off, ",")))).drop(*[f"_n_{n}" for n in properties])


def project_routes(triples: DataFrame, ns: str) -> DataFrame:
    """Typed route rows from triples with strict cardinality one and declared, distinct endpoints."""
    of = lambda cls: triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == ns + cls)).select("s").distinct()
    routes, sites = of("Route"), of("Site")
    r = pivot_properties(triples, {"source": ns + "source", "target": ns + "target", "up": ns + "up", "failure": ns + "failureRate", "repair": ns + "repairRate"}, routes)
    end = lambda c: sites.select(F.col("s").alias(c), F.lit(True).alias(f"_{c}"))
    r = r.join(end("source"), "source", "left").join(end("target"), "target", "left")
    rate = lambda c: F.col(c).try_cast("double")
    bad_rate = lambda c: rate(c).isNull() | F.isnan(rate(c)) | (rate(c) == float("inf")) | (rate(c) < 0)
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_source").isNull() | F.col("_target").isNull() | (F.col("source") == F.col("target")), "bad endpoints")
        .when(~F.col("up").isin("true", "false"), "up is not a boolean").when(bad_rate("failure") | bad_rate("repair"), "bad rate")
    )
    return r.select(F.col("s").alias("route"), "source", "target", (F.col("up") == "true").alias("up"), rate("failure").alias("failure"), rate("repair").alias("repair"), problem.alias("problem"))


def unsupported_triples(triples: DataFrame, ns: str) -> DataFrame:
    """Triples a projection would silently drop: unknown subjects, types or properties."""
    typed = triples.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(ns + "Site", ns + "Route")).select("s", F.col("o").alias("cls")).distinct()
    j = triples.join(typed, "s", "left")
    props = [ns + x for x in ("source", "target", "up", "failureRate", "repairRate")]
    code = (
        F.when(F.col("cls").isNull(), "unknown_subject").when((F.col("p") == RDF_TYPE) & ~F.col("o").isin(ns + "Site", ns + "Route"), "unknown_type")
        .when((F.col("p") != RDF_TYPE) & ((F.col("cls") != ns + "Route") | ~F.col("p").isin(*props)), "unknown_property")
    )
    return j.select("s", "p", "o", code.alias("code")).filter("code IS NOT NULL")


def state_disagreements(available: DataFrame, routes: DataFrame) -> DataFrame:
    """Availability edges (route, source, target) against routes that are up, both ways."""
    want = routes.filter("up").select("route", "source", "target")
    have = available.select("route", "source", "target")
    return one_sided(have, want, "unexpected_edge", "missing_edge")


def admission_preview(triples: DataFrame, proposals: DataFrame, content: DataFrame, ns: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts, new triples): every proposal of every cell checked at once.

    ``proposals``: proposal, cell; ``content``: proposal, module_sha256,
    evidence_sha256 of the exact bytes.  Admitted proposals add six triples.
    """
    props = {"name": ns + "name", "component": ns + "component", "module_digest": ns + "moduleDigest", "evidence_digest": ns + "evidenceDigest"}
    p = pivot_properties(triples, props, proposals.select(F.col("proposal").alias("s"))).withColumnRenamed("s", "proposal")
    # contents of one proposal that differ cannot both be its exact bytes
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).alias(c)
    content = content.groupBy("proposal").agg(one("module_sha256"), one("evidence_sha256"))
    p = p.join(proposals.distinct(), "proposal").join(content, "proposal", "left")
    members = triples.filter(F.col("p") == PROV + "hadMember").select(F.col("s").alias("cell"), F.col("o").alias("member"))
    names = triples.filter(F.col("p") == ns + "name").select(F.col("s").alias("member"), F.col("o").alias("name"))
    taken = members.join(names, "member").select("cell", "name").distinct().withColumn("_taken", F.lit(True))
    deps = triples.filter(F.col("p") == ns + "dependsOn").select(F.col("s").alias("proposal"), F.col("o").alias("member")).join(proposals, "proposal")
    gone = deps.join(members, ["cell", "member"], "left_anti").groupBy("proposal").agg(F.count(F.lit(1)).alias("_gone"))
    # an identifier is in use when anything but its own proposal points at it
    named = p.select("component").distinct()
    uses = reduce(lambda a, b: a.unionByName(b), [triples.select(F.col(c).alias("component")).join(named, "component", "left_semi") for c in ("s", "o", "p")])
    refs = uses.groupBy("component").agg(F.count(F.lit(1)).alias("_refs"))
    j = p.join(taken, ["cell", "name"], "left").join(gone, "proposal", "left").join(refs, "component", "left")
    same = p.filter("problem IS NULL").groupBy("cell", "name").agg(F.min("proposal").alias("_first"))
    j = j.join(same, ["cell", "name"], "left")
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(~F.col("module_digest").eqNullSafe(F.col("module_sha256")), "module digest mismatch")
        .when(~F.col("evidence_digest").eqNullSafe(F.col("evidence_sha256")), "evidence digest mismatch").when(F.col("_gone").isNotNull(), "dependency is not a member")
        .when(F.col("_taken"), "name is taken").when(F.col("_refs") > 1, "component identifier is in use").when(F.col("_first") != F.col("proposal"), "name is proposed twice")
    )
    receipt = F.sha2(F.to_json(F.struct("cell", "component", "evidence_digest", "module_digest", "name", "proposal")), 256)
    v = j.select("proposal", "cell", "component", "name", "module_digest", "evidence_digest", problem.alias("problem"), F.when(problem.isNull(), receipt).alias("receipt"))
    row = lambda s, pr, o, kind, dt=None: F.struct(s.alias("s"), F.lit(pr).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_datatype"))
    c = F.col("component")
    new = F.array(
        row(c, RDF_TYPE, F.lit(ns + "Component"), "iri"), row(c, RDF_TYPE, F.lit(PROV + "Entity"), "iri"), row(c, ns + "name", F.col("name"), "literal", XSD + "string"),
        row(c, ns + "moduleDigest", F.col("module_digest"), "literal", XSD + "string"), row(c, PROV + "wasDerivedFrom", F.col("proposal"), "iri"), row(F.col("cell"), PROV + "hadMember", c, "iri"),
    )
    return v, v.filter("problem IS NULL").select(F.inline(new))


def provenance_triples(verdicts: DataFrame) -> DataFrame:
    """used / generatedBy / derivedFrom rows of every admitted preview."""
    urn = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), c)
    act, before, after = urn("preview", F.col("receipt")), urn("snapshot:before", F.col("receipt")), urn("snapshot:after", F.col("receipt"))
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rows = F.array(
        row(act, RDF_TYPE, F.lit(PROV + "Activity")), row(before, RDF_TYPE, F.lit(PROV + "Entity")), row(after, RDF_TYPE, F.lit(PROV + "Entity")),
        row(act, PROV + "used", urn("sha256", F.col("module_digest"))), row(act, PROV + "used", before), row(act, PROV + "used", urn("sha256", F.col("evidence_digest"))),
        row(after, PROV + "wasGeneratedBy", act), row(after, PROV + "wasDerivedFrom", before),
    )
    return verdicts.filter("problem IS NULL").select(F.inline(rows))


_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z-]+)?)\s*\.\s*$'


def parse_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """N-Triples lines to (s, p, o, o_kind, o_datatype) with ``problem`` for other text."""
    t = F.col(column)
    df = lines.filter((F.trim(t) != "") & ~F.trim(t).startswith("#"))
    s, p, o = (F.regexp_extract(t, _TRIPLE, i) for i in (1, 2, 3))
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    lit = o.startswith('"')
    kind = F.when(lit, "literal").when(o.startswith("_:"), "blank").otherwise("iri")
    body = F.regexp_replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")
    dt = F.regexp_extract(o, r"\^\^<([^>]*)>$", 1)
    ok = t.rlike(_TRIPLE)
    return df.select(
        F.when(ok, strip(s)).alias("s"), F.when(ok, p).alias("p"), F.when(ok, F.when(lit, body).otherwise(strip(o))).alias("o"), F.when(ok, kind).alias("o_kind"),
        F.when(ok & lit, F.when(dt != "", dt).otherwise(XSD + "string")).alias("o_datatype"), F.when(~ok, "not_a_triple").alias("problem"),
    )


def read_triples(spark, path: str) -> DataFrame:
    return parse_triples(spark.read.text(path))


