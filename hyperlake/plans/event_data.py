"""The events table as logs, series, ledgers and marked point processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .data import table

EPOCH = 1704067200  # 2024-01-01, start of the events


def base(spark, sf) -> DataFrame:
    """event_id, user_id, event_type, value, k, t (seconds since the start)."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH * 1000000) / 1e6
    return e.select("event_id", "user_id", "event_type", "value", k.alias("k"), t.alias("t"))


BASE = f"""base AS (SELECT event_id, user_id, event_type, value, (props->>'$.k')::BIGINT AS k, (epoch_us(ts) - {EPOCH}000000) / 1e6 AS t FROM events)"""

KIND = {"signup": "meta", "purchase": "adaptation", "error": "external"}


def log(spark, sf) -> DataFrame:
    """One log per user: index by time, kinds, hazards and survival integrals."""
    from .. import ordered

    b = base(spark, sf).withColumn("run_id", F.col("user_id"))
    n = ordered.scan(b, ["run_id"], ["t", "event_id"], {"_n": ordered.rnumber(), "_t": ordered.rlag("t", 0.0)})
    kind = F.when(F.col("event_type").isin("click", "view"), "internal").otherwise("external")
    return n.select(
        "run_id", (F.col("_n") - 1).alias("event_index"), "event_id", kind.alias("kind"), "t", "event_type", "user_id", "k", "value",
        (1 + F.col("value")).alias("hazard"), (F.col("value") * (F.col("t") - F.col("_t")) / 86400).alias("survival_integral"),
    )


LOG = BASE + """, log AS (SELECT user_id AS run_id, row_number() OVER w - 1 AS event_index, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'internal' ELSE 'external' END AS kind,
  t, event_type, user_id, k, value, 1 + value AS hazard, value * (t - coalesce(lag(t) OVER w, 0)) / 86400 AS survival_integral FROM base WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


def whole_log(spark, sf) -> DataFrame:
    """All events as one run: an event writes its user and reads user k."""
    b = base(spark, sf).select(F.lit("all").alias("run_id"), "event_id", "user_id", "k", "event_type", "value", "t")
    from .. import ordered

    return ordered.scan(b, ["run_id"], ["t", "event_id"], {"event_index": ordered.rnumber()})


WHOLE = BASE + """, whole AS (SELECT 'all' AS run_id, event_id, user_id, k, event_type, value, t, row_number() OVER (ORDER BY t, event_id) AS event_index FROM base)"""
