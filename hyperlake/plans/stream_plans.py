"""Registered queries: the events table read as a stream, drained and compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut, shared_dir
from ..streaming import stateful as st
from .adaptive_plans import SERIES, SPELLS, spells
from .data import q6, r6
from .event_data import BASE, EPOCH, base
from .eventlog_plans import STOCK
from .registry import query


def stream(spark, sf):
    e = st.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH * 1000000) / 1e6
    return e.select("event_id", "user_id", "event_type", "value", k.alias("k"), t.alias("t"), "ts")


def drained(spark, df):
    return st.drain(df, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


@query("stream_ordered_ingest", f"""WITH {BASE}, x AS (SELECT user_id AS run_id, event_id::VARCHAR AS event_id, 'accepted' AS status FROM base UNION ALL SELECT user_id, event_id::VARCHAR, 'duplicate' FROM base WHERE event_id % 10 = 0) SELECT run_id, event_id, status, count(*) AS n FROM x GROUP BY ALL""")
def ingest(spark, sf):
    s = stream(spark, sf).withColumn("copies", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 10 == 0, 2).otherwise(1))))
    s = s.select(F.col("user_id").alias("run_id"), "event_id", "t", F.col("k").alias("namespace"), F.col("copies").alias("sequence"))
    return drained(spark, st.ordered_ingest(s)).groupBy("run_id", "event_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("stream_handle_state", f"""WITH {BASE}, m AS (SELECT user_id AS handle_id, t, event_id, value, event_type, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS x FROM base)
SELECT handle_id, max_by(value, (t, event_id)) FILTER (event_type <> 'error') AS last_value, count(*) FILTER (event_type <> 'error') AS inputs FROM m GROUP BY handle_id HAVING count(*) FILTER (event_type <> 'error') > 0""")
def handles(spark, sf):
    mode = F.when(F.col("event_type") == "error", "signal_only").when(F.col("event_type") == "signup", "replace").otherwise("merge")
    s = stream(spark, sf).select(F.col("user_id").alias("handle_id"), "t", F.col("event_id").alias("sequence"), mode.alias("mode"),
                                 F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("value"), F.col("event_id").alias("id"))).alias("payload"))
    got = drained(spark, st.handle_state(s, ["kind"]))
    last = F.max_by(F.get_json_object("attributes", "$.value").cast("double"), F.struct("t", F.get_json_object("attributes", "$.id").cast("long")))
    return got.groupBy("handle_id").agg(last.alias("last_value"), F.count(F.lit(1)).alias("inputs"))


@query("stream_statistics", f"""WITH {SERIES}, tr AS (SELECT user_id, t, event_id, exp(-(t - min(t) OVER (PARTITION BY user_id)) / 86400) * sum(exp((t - mt) / 86400) * value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS z FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS mt FROM base)),
 lt AS (SELECT user_id, max_by(z, (t, event_id)) AS z FROM tr GROUP BY user_id) SELECT user_id, n, {q6('list_reduce(l, lambda a, x: 0.35 * x + 0.65 * a)', 5)} AS ema, {q6('z', 5)} AS trace, {q6('0.01 * (list_sum(l) - 50 * n)', 5)} AS theta FROM sr JOIN lt USING (user_id)""")
def statistics(spark, sf):
    s = stream(spark, sf).select("user_id", "t", "event_id", "value")
    got = drained(spark, st.statistics(s, ["user_id"], ["t", "event_id"], "value", tau=86400.0, target=50.0))
    last = got.groupBy("user_id").agg(F.max_by(F.struct("n", "ema", "trace", "theta"), "n").alias("s")).select("user_id", "s.*")
    return last.withColumns({c: r6(c, 5) for c in ("ema", "trace", "theta")})


@query("stream_outage_transitions", f"""WITH {BASE}, a AS (SELECT user_id, t, event_id, event_type <> 'error' AS up FROM base), l AS (SELECT *, lag(up) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM a) SELECT user_id, {q6('t')} AS t, up AS available FROM l WHERE p IS NULL OR p <> up""")
def outage(spark, sf):
    s = stream(spark, sf).select("user_id", "t", "event_id", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("x"))
    return drained(spark, st.outage(s, ["user_id"], ["t", "event_id"], "x")).withColumn("t", r6("t"))


@query("stream_outage_prefix", f"""WITH {SPELLS}, l AS (SELECT *, lag(available) OVER (PARTITION BY user_id ORDER BY n) AS was FROM avail) SELECT user_id, {q6('t')} AS t, available FROM l WHERE was IS NULL OR was <> available""")
def outage_prefix(spark, sf):
    return drained(spark, st.outage(spells(stream(spark, sf)), ["user_id"], ["t", "event_id"], "x")).withColumn("t", r6("t"))


#: three micro-batches; an event of every 13th user comes again in the next one, and one of every 11th comes a batch too late
LATE = f"""{BASE}, m AS (SELECT *, CASE WHEN t < 864000 THEN 0 WHEN t < 1728000 THEN 1 ELSE 2 END AS own, row_number() OVER (PARTITION BY user_id, CASE WHEN t < 864000 THEN 0 WHEN t < 1728000 THEN 1 ELSE 2 END ORDER BY t DESC, event_id DESC) AS back FROM base),
 sent AS (SELECT user_id, event_id, t, own + CASE WHEN user_id % 11 = 3 AND back = 1 AND own < 2 THEN 1 ELSE 0 END AS batch, 0 AS again FROM m
   UNION ALL SELECT user_id, event_id, t, own + 1, 1 FROM m WHERE user_id % 13 = 5 AND back = 2 AND own < 2)"""


@query("stream_ingest_over_batches", f"""WITH RECURSIVE {LATE}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch, t, again, event_id) AS n FROM sent),
 w AS (SELECT user_id, n, 0::BIGINT AS dummy, event_id, t AS last, 'accepted' AS status, [event_id] AS ids FROM o WHERE n = 1
   UNION ALL SELECT o.user_id, o.n, 0, o.event_id, CASE WHEN list_contains(ids, o.event_id) OR o.t < last THEN last ELSE o.t END,
     CASE WHEN list_contains(ids, o.event_id) THEN 'duplicate' WHEN o.t < last THEN 'late' ELSE 'accepted' END,
     CASE WHEN list_contains(ids, o.event_id) OR o.t < last THEN ids ELSE list_append(ids, o.event_id) END FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT user_id AS run_id, event_id::VARCHAR AS event_id, status, count(*) AS n FROM w GROUP BY ALL""")
def ingest_over_batches(spark, sf):
    """Events in three micro-batches, with events that come late and events that come twice, batches apart."""
    b = base(spark, sf)
    own = F.when(F.col("t") < 864000, 0).when(F.col("t") < 1728000, 1).otherwise(2)
    back = F.row_number().over(Window.partitionBy("user_id", "own").orderBy(F.desc("t"), F.desc("event_id")))
    m = b.withColumn("own", own).withColumn("back", back)
    late = (F.col("user_id") % 11 == 3) & (F.col("back") == 1) & (F.col("own") < 2)
    first = m.select("user_id", "event_id", "t", (F.col("own") + late.cast("int")).alias("batch"), F.lit(0).alias("again"))
    again = m.filter("user_id % 13 = 5 and back = 2 and own < 2").select("user_id", "event_id", "t", (F.col("own") + 1).alias("batch"), F.lit(1).alias("again"))
    sent = cut(first.union(again).select(F.col("user_id").alias("run_id"), "event_id", "t", F.col("again").alias("namespace"), F.col("event_id").alias("sequence"), "batch"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(3):
        sent.filter(F.col("batch") == k).write.mode("append").parquet(f"{path}/in")
        out = st.drain(st.ordered_ingest(spark.readStream.schema(sent.schema).parquet(f"{path}/in")), f"{path}/out")
    return out.groupBy("run_id", "event_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("stream_inventory", f"WITH RECURSIVE {STOCK} SELECT sku, event_id, status, a + r AS on_hand, r AS reserved FROM st WHERE n > 0")
def inventory(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "receive").when(F.col("event_type") == "purchase", "reserve").when(F.col("event_type") == "error", "release")
    s = stream(spark, sf).select(F.col("user_id").alias("sku"), "t", "event_id", kind.alias("kind"), (1 + F.floor("value") % 5).alias("quantity")).filter("kind IS NOT NULL")
    return drained(spark, st.inventory(s))


@query("stream_scheduled_assignments", f"""WITH {BASE}, l AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id) AS rate FROM base)
SELECT user_id AS run_id, event_id, {q6('coalesce(rate, 1.0)')} AS rate FROM l WHERE event_type <> 'signup'""")
def scheduled(spark, sf):
    s = stream(spark, sf).select(F.col("user_id").alias("run_id"), "event_id", F.col("event_id").alias("sequence"), "t", F.when(F.col("event_type") == "signup", "rate").alias("parameter"), "value")
    return drained(spark, st.scheduled(s, {"rate": 1.0})).withColumn("rate", r6("rate"))


@query("stream_windowed_counts", """SELECT time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS end, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'click') AS n_click FROM events
 GROUP BY ALL HAVING time_bucket(INTERVAL '6 hours', any_value(ts)) + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def windowed(spark, sf):
    s = stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("mark"))
    return drained(spark, st.windowed_counts(s, "ts", "6 hours", "10 minutes", ("error", "click")))
