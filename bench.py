"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.  Each time covers
building the plan (with the measuring jobs some operators run) and computing the
whole result into a no-op sink.  ``BENCH_ONLY`` limits the run to name prefixes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "match_two_edge_path", "match_same_nation_supply_without_return", "match_anchored", "match_variable_unification", "graph_validate",
    "rewrite_occurrences", "rewrite_delta", "rewrite_conflict_free_fixpoint", "eventlog_causal_edges", "eventlog_path_likelihood",
    "eventlog_replay_violations", "process_build_intervals", "process_compensator_increments", "process_nll", "adaptive_fit_ema_alpha",
    "effects_fidelity", "effects_fidelity_report", "bootstrap_mean_abs_error", "trust_fit_field", "claims_score_table", "claims_summary_bootstrap",
    "summary_ensemble_linear_quantiles", "inventory_ledger", "admission_classify", "triples_shape_check", "telemetry_kpm_lines", "stream_statistics",
)


def main() -> None:
    from hyperlake.plans import registry
    from hyperlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = local_session(cpus, "bench")
    queries = registry.queries()
    names = [n for n in HEADLINE if not only or any(n.startswith(p) for p in only)]
    # one small query starts the JVM's code paths and the Python workers
    queries["effects_by_scenario"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
