"""Event logs: integrity, causality, likelihood, state at a time, inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ordered
from ..ordered import rlag, rlast, rnumber, rsum
from ..session import cut

RUN = ("run_id",)
# fixed values: rank of simultaneous deterministic event kinds
KIND_RANK = {"external": 0, "adaptation": 1, "meta": 2}


def event_order(*queues: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Merge event queues and number them: time, kind rank, namespace, sequence.

    Every queue carries keys, t, kind, namespace, sequence, event_id.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), queues)
    rank = F.lit(len(KIND_RANK))
    for kind, r in KIND_RANK.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    ranked = merged.withColumn("kind_rank", rank)
    got = ordered.scan(ranked, keys, ["t", "kind_rank", "namespace", "sequence"], {"_n": rnumber()})
    return got.withColumn("event_index", F.col("_n") - 1).drop("_n")


def order_violations(events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Events earlier than their predecessor or whose index is not the next one."""
    got = ordered.scan(events, keys, ["event_index"], {"_t": rlag("t"), "_i": rlag("event_index")})
    code = F.when(F.col("t") < F.col("_t"), "time_decreases").when(F.col("event_index") != F.col("_i") + 1, "index_gap")
    return got.select(*keys, "event_index", code.alias("code")).filter("code IS NOT NULL")


def hash_chain_violations(events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Events whose pre-hash is not the previous post-hash."""
    got = ordered.scan(events, keys, ["event_index"], {"_h": rlag("post_state_hash")})
    return got.filter(F.col("_h").isNotNull() & (F.col("_h") != F.col("pre_state_hash"))).select(*keys, "event_index", F.lit("broken_hash_chain").alias("code"))


def footprint(events: DataFrame, deltas: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Reads and writes per event: keys, event_index, event_id, entity, mode.

    Matched entities and a bound vertex are read; entities of the delta are
    written; changed parameter and memory paths are written state paths.
    """
    base = [*keys, "event_index", "event_id"]
    matched = F.when(
        F.col("kind") == "internal",
        F.concat(F.map_values(F.col("vertex_map")), F.map_values(F.col("edge_map"))),
    ).when((F.col("kind") == "external") & F.col("bound_vertex").isNotNull(), F.array("bound_vertex"))
    reads = events.select(*base, F.explode(matched).alias("entity")).withColumn("mode", F.lit("read"))
    writes = deltas.join(events.select(*base), [*keys, "event_index"]).select(*base, F.col("entity_id").alias("entity"), F.lit("write").alias("mode"))

    def paths(before: str, after: str, prefix: str) -> Column:
        merged = F.map_zip_with(F.col(before), F.col(after), lambda k, a, b: ~a.eqNullSafe(b))
        return F.transform(F.map_keys(F.map_filter(merged, lambda k, v: v)), lambda k: F.concat(F.lit(prefix + "."), k))

    state = F.concat(paths("parameter_before", "parameter_after", "parameters"), paths("memory_before", "memory_after", "memory"))
    changed = events.select(*base, F.explode(state).alias("entity")).withColumn("mode", F.lit("write_path"))
    return reads.unionByName(writes).unionByName(changed).distinct()


def last_writer(prints: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """For every touch the latest earlier event that wrote the same entity or path."""
    # one row per (entity, event): an event that reads and writes counts as a writer
    touch = prints.groupBy(*keys, "entity", "event_index", "event_id").agg(F.bool_or(F.col("mode") != "read").alias("w"))
    mark = F.when(F.col("w"), F.col("event_id"))
    return ordered.scan(touch, [*keys, "entity"], ["event_index"], {"writer": rlast(mark, inclusive=False)})


def causal_edges(prints: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Distinct (cause, effect) pairs: latest writer of anything the event touches."""
    got = last_writer(prints, keys).filter(F.col("writer").isNotNull() & (F.col("writer") != F.col("event_id")))
    return got.select(*keys, F.col("writer").alias("cause"), F.col("event_id").alias("effect")).distinct()


def _chains(step: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, node, chain, pos``: disjoint paths along the edges ``_from`` -> ``event_id`` that cover all nodes.

    Every node hands on to at most one node and takes from at most one.  Where a path starts and how far down a node lies
    is found by pointer jumping, four jumps a round, so a path of n nodes takes log4(n) rounds.  Nodes of a cycle, which
    has no start, stay paths of their own.
    """
    pick = step.groupBy(*keys, "_from").agg(F.max("event_id").alias("node")).groupBy(*keys, "node").agg(F.max("_from").alias("_up"))
    nodes = step.select(*keys, F.col("_from").alias("node")).union(step.select(*keys, "event_id")).distinct()
    now = cut(nodes.join(pick, [*keys, "node"], "left").select(*keys, "node", F.coalesce("_up", "node").alias("chain"), F.col("_up").isNotNull().cast("long").alias("pos"), F.col("_up").isNull().alias("done")))
    total, jumps = now.count(), 1
    while jumps <= total and not now.filter("not done").isEmpty():
        above = now.select(*keys, F.col("node").alias("chain"), F.col("chain").alias("_chain"), F.col("pos").alias("_pos"), F.col("done").alias("_done"))
        for _ in range(3):
            # who has arrived joins with its own start, which moves it no further
            now = now.join(above, [*keys, "chain"]).select(*keys, "node", F.col("_chain").alias("chain"), (F.col("pos") + F.when(F.col("done"), 0).otherwise(F.col("_pos"))).alias("pos"), (F.col("done") | F.col("_done")).alias("done"))
        now, jumps = cut(now), jumps * 4
    return now.select(*keys, "node", F.when(F.col("done"), F.col("chain")).otherwise(F.col("node")).alias("chain"), F.when(F.col("done"), F.col("pos")).otherwise(F.lit(0)).alias("pos"))


def reachable(edges: DataFrame, targets: DataFrame, keys: Sequence[str] = RUN, forward: bool = False) -> DataFrame:
    """Ancestors (or descendants with ``forward``) of each target: keys, target, event_id.

    Events are laid out on chains of the causal graph.  What a target reaches on a chain is all of it from some place on,
    so the search carries one place for each target and chain and moves over edges between chains only.  The number of
    rounds is how often a path has to change chains, not how long it is.
    """
    src, dst = ("cause", "effect") if forward else ("effect", "cause")
    step = cut(edges.select(*keys, F.col(src).alias("_from"), F.col(dst).alias("event_id")).distinct())
    placed = cut(_chains(step, keys))
    end = lambda column, chain, pos: placed.select(*keys, F.col("node").alias(column), F.col("chain").alias(chain), F.col("pos").alias(pos))
    across = step.join(end("_from", "chain", "_p"), [*keys, "_from"]).join(end("event_id", "_c2", "_p2"), [*keys, "event_id"])
    across = cut(across.filter("chain <> _c2 or _p2 <= _p").select(*keys, "chain", "_p", "_c2", "_p2"))
    ids = [*keys, "target", "chain"]
    # a target itself is where its search starts and no result, unless it lies on a cycle
    starts = targets.select(*keys, F.col("event_id").alias("target")).distinct()
    frontier = cut(starts.join(end("target", "chain", "pos"), [*keys, "target"]).select(*ids, "pos"))
    known = frontier
    while True:
        met = frontier.join(across, [*keys, "chain"]).filter("_p >= pos").select(*keys, "target", F.col("_c2").alias("chain"), F.col("_p2").alias("pos"))
        met = met.groupBy(*ids).agg(F.min("pos").alias("pos"))
        frontier = cut(met.join(known.withColumnRenamed("pos", "_was"), ids, "left").filter("_was is null or pos < _was").select(*ids, "pos"))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier).groupBy(*ids).agg(F.min("pos").alias("pos")))
    reached = known.withColumnRenamed("pos", "_least").join(placed, [*keys, "chain"]).filter("pos >= _least").select(*keys, "target", F.col("node").alias("event_id"))
    looped = reached.filter("target = event_id").join(step.withColumnRenamed("event_id", "target"), [*keys, "target"])
    looped = looped.select(*keys, "target", F.col("_from").alias("event_id")).join(reached, [*keys, "target", "event_id"], "left_semi")
    return reached.filter("target <> event_id").unionByName(looped.select(*keys, "target", F.col("target").alias("event_id")).distinct())


def state_as_of(initial: DataFrame, deltas: DataFrame, index: int | None, keys: Sequence[str] = RUN) -> DataFrame:
    """Entities alive after event ``index``: keys, entity_id, type_id, attributes.

    The latest change per entity is a max over a struct, which combines on the
    map side; no entity history is gathered or sorted.
    """
    d = deltas if index is None else deltas.filter(F.col("event_index") <= index)
    cols = [*keys, "entity_id"]
    rows = initial.select(*cols, F.lit(-1).cast("long").alias("event_index"), F.lit("create").alias("op"), "type_id", F.col("attributes").alias("after")).unionByName(
        d.select(*cols, F.col("event_index").cast("long").alias("event_index"), "op", "type_id", "after")
    )
    latest = rows.groupBy(*cols).agg(F.max_by(F.struct("op", "type_id", "after"), "event_index").alias("_l"))
    return latest.filter(F.col("_l.op") != "delete").select(*cols, F.col("_l.type_id").alias("type_id"), F.col("_l.after").alias("attributes"))


def replay_violations(initial: DataFrame, deltas: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Deletes or updates of an absent entity, creates of a present one, stale ``before``."""
    cols = [*keys, "entity_id"]
    rows = initial.select(*cols, F.lit(-1).cast("long").alias("event_index"), F.lit("create").alias("op"), F.lit(None).cast("string").alias("before"), F.col("attributes").alias("after")).unionByName(
        deltas.select(*cols, F.col("event_index").cast("long").alias("event_index"), "op", "before", "after")
    )
    got = ordered.scan(rows, cols, ["event_index"], {"_p": rlag(F.struct("op", "after"))}).filter("event_index >= 0")
    alive = F.col("_p").isNotNull() & (F.col("_p.op") != "delete")
    code = (
        F.when((F.col("op") == "create") & alive, "create_of_present").when((F.col("op") == "delete") & ~alive, "delete_of_absent")
        .when((F.col("op") == "update") & ~alive, "update_of_absent")
        .when((F.col("op") != "create") & F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("_p.after")), "stale_before")
    )
    return got.select(*cols, "event_index", code.alias("code")).filter("code IS NOT NULL")


def final_state_violations(events: DataFrame, toggled: str, value: str, reported: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Entities whose last logged value differs from the reported final state."""
    last = events.groupBy(*keys, toggled).agg(F.max_by(value, "event_index").alias("last_value"))
    both = last.join(reported.select(*keys, toggled, F.col(value).alias("reported")), [*keys, toggled])
    return both.filter(~F.col("last_value").eqNullSafe(F.col("reported")))


def path_likelihood(events: DataFrame, terminal: DataFrame | None = None, keys: Sequence[str] = RUN) -> DataFrame:
    """Log-likelihood of each run: sum of log hazards minus the survival integrals.

    Needs kind, hazard, survival_integral, t.  ``terminal`` (keys, terminal_time,
    terminal_activity) adds the tail after the last event.  ``problem`` names the
    first reason a run has no likelihood, else null.
    """
    internal = F.col("kind") == "internal"
    s, h = F.col("survival_integral"), F.col("hazard")
    inf = F.lit(float("inf"))
    bad_s = s.isNull() | F.isnan(s) | (s == inf) | (s < 0)
    bad_h = internal & (h.isNull() | F.isnan(h) | (h == inf) | (h <= 0))
    got = events.groupBy(*keys).agg(
        F.sum(F.when(internal & ~bad_h, F.log(h)).otherwise(0.0)).alias("log_hazard_sum"), F.sum(F.when(~bad_s, s).otherwise(0.0)).alias("integrated_activity"),
        F.count_if(internal).alias("internal_events"), F.count_if(~internal).alias("conditioned_events"), F.max("t").alias("horizon"),
        F.count_if(bad_s).alias("_bs"), F.count_if(bad_h).alias("_bh"),
    )
    problem = F.when(F.col("_bs") > 0, "invalid_survival_integral").when(F.col("_bh") > 0, "nonpositive_hazard")
    if terminal is not None:
        got = got.join(terminal.select(*keys, "terminal_time", "terminal_activity"), list(keys), "left")
        gap = F.col("terminal_time") - F.col("horizon")
        a = F.col("terminal_activity")
        problem = problem.when(gap < 0, "terminal_time_precedes_last_event").when((gap > 0) & (a.isNull() | (a < 0) | F.isnan(a) | (a == inf)), "invalid_terminal_activity")
        got = got.withColumn("integrated_activity", F.col("integrated_activity") + F.when(gap > 0, a * gap).otherwise(0.0)).withColumn("horizon", F.greatest("horizon", "terminal_time"))
    got = got.withColumn("problem", problem)
    ll = F.when(F.col("problem").isNull(), F.col("log_hazard_sum") - F.col("integrated_activity"))
    return got.select(*keys, ll.alias("log_likelihood"), "log_hazard_sum", "integrated_activity", "internal_events", "conditioned_events", "horizon", "problem")


def kind_summary(events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return events.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("events"), F.max("t").alias("last_t"))


def observable_series(events: DataFrame, contribution: Column, keys: Sequence[str] = RUN, initial: float = 0.0) -> DataFrame:
    """Value of a count or sum observable after every event, from its change per event."""
    got = ordered.scan(events.withColumn("_d", contribution), keys, ["event_index"], {"_v": rsum("_d")})
    return got.withColumn("value", F.col("_v") + F.lit(initial)).drop("_d", "_v")


def max_concurrency(intervals: DataFrame, start: str, end: str, keys: Sequence[str] = RUN) -> DataFrame:
    """Largest number of simultaneously open intervals; an end frees its slot first."""
    moves = intervals.select(*keys, F.inline(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
    ))).filter(F.col("t").isNotNull())
    # moves at one instant are summed first: far fewer rows reach the ordered scan
    net = moves.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    level = ordered.scan(net, keys, ["t"], {"level": rsum("d")})
    return level.groupBy(*keys).agg(F.max("level").alias("max_concurrency"))


def first_passage(events: DataFrame, predicate: Column, keys: Sequence[str] = RUN, initial: Column | None = None) -> DataFrame:
    """First time a predicate holds: 0 if initially true, null if never."""
    hit = F.min(F.when(predicate, F.col("t")))
    got = events.groupBy(*keys).agg(hit.alias("first_passage"), *([F.bool_or(initial).alias("_0")] if initial is not None else []))
    if initial is not None:
        got = got.withColumn("first_passage", F.when(F.col("_0"), 0.0).otherwise(F.col("first_passage"))).drop("_0")
    return got


def explosion_check(events: DataFrame, window: float, limit: int, keys: Sequence[str] = RUN) -> DataFrame:
    """Events with more than ``limit`` events in the trailing window ending at them.

    Per key, more than ``limit`` events in the window means the event ``limit``
    places earlier is at most ``window`` older: one lag, and row numbers where a
    key is so hot that it is split.
    """
    rows = ordered.measured(events.select(*keys, "event_index", "t"), keys, "event_index")
    if ordered.CHUNK not in rows.columns:
        back = F.lag("t", limit).over(Window.partitionBy(*keys).orderBy("event_index"))
        return ordered.unmarked(rows).withColumn("_t0", back).filter(F.col("t") - F.col("_t0") <= window).select(*keys, "event_index", "t")
    n = ordered.unmarked(ordered.scan(rows, keys, ["event_index"], {"_rn": rnumber()}))
    earlier = n.select(*keys, (F.col("_rn") + limit).alias("_rn"), F.col("t").alias("_t0"))
    hit = n.join(earlier, [*keys, "_rn"]).filter(F.col("t") - F.col("_t0") <= window)
    return hit.select(*keys, "event_index", "t")


def transitions_only(series: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows where the value differs from the previous one (the first row is kept)."""
    got = ordered.scan(series, keys, order, {"_p": rlag(F.struct(F.col(value).alias("v")))})
    return got.filter(F.col("_p").isNull() | ~F.col("_p.v").eqNullSafe(F.col(value))).drop("_p")


def active_rules_as_of(meta: DataFrame, t: float | None = None, keys: Sequence[str] = RUN) -> DataFrame:
    """Repertoire after all meta events up to ``t``: rule_id, template_id, enabled."""
    m = meta if t is None else meta.filter(F.col("t") <= t)
    last = m.groupBy(*keys, "rule_id").agg(
        F.max_by("action", F.struct("t", "sequence")).alias("action"),
        F.max_by(F.when(F.col("action") == "INSTANTIATE", F.col("template_id")), F.when(F.col("action") == "INSTANTIATE", F.struct("t", "sequence"))).alias("template_id"),
    )
    return last.filter(F.col("action") != "REMOVE").withColumn("enabled", F.col("action") != "DISABLE").drop("action")


def instance_limit(meta: DataFrame, limits: Mapping[str, int] | DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Meta events at which a template has more live instances than it may."""
    step = F.when(F.col("action") == "INSTANTIATE", 1).when(F.col("action") == "REMOVE", -1).otherwise(0)
    level = ordered.scan(meta.withColumn("_d", step), [*keys, "template_id"], ["t", "sequence"], {"live": rsum("_d")})
    if isinstance(limits, DataFrame):
        level = level.join(limits, "template_id")
    else:
        level = level.withColumn("max_instances", F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("template_id")])
    return level.filter(F.col("live") > F.col("max_instances")).select(*keys, "template_id", "t", "sequence", "live")


# --- weighted choice ---------------------------------------------------------


def weighted_select(items: DataFrame, draws: DataFrame, keys: Sequence[str], item: str, weight: str) -> DataFrame:
    """Inverse-CDF choice: smallest item whose cumulative weight exceeds u * total.

    ``draws`` has the keys, a draw id and ``u``.  Zero weights are never chosen;
    a draw past the last cumulative value takes the last positive item.
    """
    live = items.filter(F.col(weight) > 0).select(*keys, item, F.col(weight).cast("double").alias("_w"))
    cum = ordered.scan(live, keys, [item], {"_c": rsum("_w")})
    # the total is the last cumulative value, so u < 1 always meets an item
    totals = cum.groupBy(*keys).agg(F.max("_c").alias("_t"), F.max(item).alias("_last"))
    aimed = draws.join(totals, list(keys)).withColumn("_at", F.col("u") * F.col("_t"))
    # as-of: union the targets with the cumulative steps and look forward to the next step
    steps = cum.select(*keys, F.col("_c").alias("_x"), F.lit(1).alias("_o"), F.col(item).alias("_item"), F.lit(None).cast("string").alias("draw"), F.lit(None).cast("double").alias("u"), F.lit(None).cast(dict(cum.dtypes)[item]).alias("_last"))
    marks = aimed.select(*keys, F.col("_at").alias("_x"), F.lit(2).alias("_o"), F.lit(None).cast(dict(cum.dtypes)[item]).alias("_item"), F.col("draw").cast("string").alias("draw"), "u", "_last")
    got = ordered.scan(steps.unionByName(marks), keys, ["_x", "_o"], {"_n": ordered.rnext("_item")})
    return got.filter("_o = 2").select(*keys, "draw", "u", F.coalesce("_n", "_last").alias(item))


def selection_probability(occurrences: DataFrame, rate: str = "hazard", rule: str = "rule_id", keys: Sequence[str] = ()) -> DataFrame:
    """Rate over the rule's activity and over the total, from two grouped totals.

    A rule, or all rules of a key, without any activity cannot be chosen from: the probability is null.
    """
    rules = occurrences.groupBy(*keys, rule).agg(F.sum(rate).alias("rule_activity"))
    total = rules.groupBy(*keys).agg(F.sum("rule_activity").alias("total_activity"))
    if keys:
        rules = rules.join(total, list(keys))
    else:
        rules = rules.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")
    got = occurrences.join(rules, [*keys, rule])
    return got.withColumns({"p_in_rule": F.try_divide(rate, "rule_activity"), "p_overall": F.try_divide(rate, "total_activity")})


def activity(occurrences: DataFrame, rate: str = "hazard", rule: str = "rule_id") -> DataFrame:
    """Activity per rule with the total in the row whose rule is null."""
    return occurrences.rollup(rule).agg(F.sum(rate).alias("activity"), F.count(F.lit(1)).alias("occurrences"))


