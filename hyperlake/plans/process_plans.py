"""Registered queries: intervals, rates, compensators and calibration tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pointprocess as pp
from .bootstrap_plans import draws_sql
from .data import q6, r6, table
from .event_data import BASE, base
from .registry import query

H = 2678400.0
MARKS = ("error", "purchase", "click")
B, SEED = 200, 7


def obs(spark, sf):
    return base(spark, sf).filter("event_type = 'view'").select(F.col("user_id").alias("trace"), "t")


def events(spark, sf):
    return base(spark, sf).filter(F.col("event_type").isin(*MARKS)).select(F.col("user_id").alias("trace"), "t", F.col("event_type").alias("mark"))


def intervals(spark, sf):
    return pp.build_intervals(obs(spark, sf), events(spark, sf), MARKS, H)


def counts(spark, sf):
    return pp.long_counts(intervals(spark, sf), MARKS)


IV = BASE + f""", o AS (SELECT user_id AS trace, t, row_number() OVER w - 1 AS i, lead(t, 1, {H}) OVER w - t AS dt, lead(t, 1, {H}) OVER w AS nt FROM base WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 ev AS (SELECT user_id AS trace, t, event_type AS mark, event_id FROM base WHERE event_type IN ('error', 'purchase', 'click')),
 ei AS (SELECT ev.*, o.i FROM ev ASOF JOIN o ON ev.trace = o.trace AND ev.t >= o.t),
 iv AS (SELECT o.trace, o.i, o.t, o.dt, count(*) FILTER (mark = 'error') AS n_error, count(*) FILTER (mark = 'purchase') AS n_purchase, count(*) FILTER (mark = 'click') AS n_click FROM o LEFT JOIN ei USING (trace, i) GROUP BY ALL),
 lg AS (SELECT *, coalesce(lag(n_error) OVER w / greatest(lag(dt) OVER w, 1e-6), 0) AS lag_rate_error, coalesce(lag(n_purchase) OVER w, 0) AS lag_n_purchase, coalesce(lag(n_click) OVER w, 0) AS lag_n_click FROM iv WINDOW w AS (PARTITION BY trace ORDER BY i)),
 cnt AS (SELECT trace, i, t, dt, mark, n FROM (SELECT trace, i, t, dt, n_error AS error, n_purchase AS purchase, n_click AS click FROM iv) UNPIVOT (n FOR mark IN (error, purchase, click))),
 cr AS (SELECT mark, (sum(n) + 1e-6) / greatest(sum(dt), 1e-9) AS rate FROM cnt GROUP BY mark),
 rates AS (SELECT 'constant' AS model, cnt.*, rate, (n + 0.5) / (dt + 3600) AS true_rate FROM cnt JOIN cr USING (mark) UNION ALL SELECT 'cyclic', cnt.*, rate * (0.6 + 0.2 * (i % 5)), (n + 0.5) / (dt + 3600) FROM cnt JOIN cr USING (mark))"""


def rates(spark, sf):
    c = counts(spark, sf)
    fit = pp.constant_baseline(c, pp.constant_rates(c)).withColumn("true_rate", (F.col("n") + 0.5) / (F.col("dt") + 3600))
    models = F.array(F.struct(F.lit("constant").alias("model"), F.col("rate").alias("rate")), F.struct(F.lit("cyclic").alias("model"), (F.col("rate") * (0.6 + 0.2 * (F.col("i") % 5))).alias("rate")))
    return fit.withColumn("_m", F.explode(models)).select("trace", "i", "t", "dt", "mark", "n", "true_rate", "_m.model", "_m.rate")


@query("process_interval_exposure", f"WITH {IV} SELECT trace, i, {q6('t')} AS t, {q6('dt')} AS dt FROM o")
def exposure(spark, sf):
    return pp.interval_dt(obs(spark, sf), H).select("trace", "i", r6("t").alias("t"), r6("dt").alias("dt"))


@query("process_as_of_binning", f"WITH {IV} SELECT trace, mark, i, count(*) AS n FROM ei GROUP BY ALL")
def binning(spark, sf):
    return pp.as_of_interval(obs(spark, sf), events(spark, sf)).groupBy("trace", "mark", "i").agg(F.count(F.lit(1)).alias("n"))


@query("process_build_intervals", f"WITH {IV} SELECT trace, i, {q6('t')} AS t, {q6('dt')} AS dt, n_error, n_purchase, n_click, {q6('lag_rate_error', 9)} AS lag_rate_error, lag_n_purchase, lag_n_click FROM lg")
def build(spark, sf):
    return intervals(spark, sf).withColumns({"t": r6("t"), "dt": r6("dt"), "lag_rate_error": r6("lag_rate_error", 9)})


@query("process_nonpositive_exposure", f"WITH {IV}, d AS (SELECT *, CASE WHEN i % 9 = 0 THEN 0 ELSE dt END AS d2 FROM o) SELECT trace, i FROM d WHERE NOT d2 > 0")
def bad_exposure(spark, sf):
    iv = pp.interval_dt(obs(spark, sf), H).withColumn("dt", F.when(F.col("i") % 9 == 0, 0.0).otherwise(F.col("dt")))
    return pp.nonpositive_exposure(iv).select("trace", "i")


@query("process_constant_rates", f"WITH {IV} SELECT mark, {q6('rate * 1e6')} AS rate_per_million FROM cr")
def constant(spark, sf):
    return pp.constant_rates(counts(spark, sf)).select("mark", r6(F.col("rate") * 1e6).alias("rate_per_million"))


@query("process_constant_baseline", f"WITH {IV} SELECT trace, mark, {q6('sum(rate * dt)')} AS expected FROM rates WHERE model = 'constant' GROUP BY ALL")
def baseline(spark, sf):
    c = counts(spark, sf)
    return pp.constant_baseline(c, pp.constant_rates(c)).groupBy("trace", "mark").agg(r6(F.sum(F.col("rate") * F.col("dt"))).alias("expected"))


@query("process_nll", f"""WITH {IV}, c AS (SELECT model, trace, i, sum(rate * dt - n * ln(greatest(rate, 1e-8))) AS l, sum(n) AS n FROM rates GROUP BY ALL)
SELECT model, {q6('sum(l)', 3)} AS nll, count(*) AS intervals, sum(n)::BIGINT AS events, {q6('sum(l) / count(*)')} AS nll_per_interval, {q6('sum(l) / sum(n)')} AS nll_per_event FROM c GROUP BY model""")
def nll(spark, sf):
    return pp.nll(rates(spark, sf), ["model"]).withColumns({"nll": r6("nll", 3), "nll_per_interval": r6("nll_per_interval"), "nll_per_event": r6("nll_per_event")})


RK = "rank() OVER (PARTITION BY model ORDER BY {0}) + (count(*) OVER (PARTITION BY model, {0}) - 1) / 2.0"


@query("process_rate_error", f"""WITH {IV}, r AS (SELECT *, {RK.format('rate')} AS rp, {RK.format('true_rate')} AS rt FROM rates)
SELECT model, {q6('avg(abs(rate - true_rate)) * 1e6', 4)} AS rate_mae, {q6('sqrt(avg((rate - true_rate)^2)) * 1e6', 4)} AS rate_rmse, {q6('corr(rp, rt)', 5)} AS rate_spearman FROM r GROUP BY model""")
def rate_error(spark, sf):
    # rates round-tripped to 15 digits so that both engines tie the same values
    got = pp.rate_error(rates(spark, sf), ["model"])
    return got.select("model", r6(F.col("rate_mae") * 1e6, 4).alias("rate_mae"), r6(F.col("rate_rmse") * 1e6, 4).alias("rate_rmse"), r6("rate_spearman", 5).alias("rate_spearman"))


@query("process_count_ratio", f"WITH {IV} SELECT model, mark, {q6('sum(rate * dt) / greatest(sum(n), 1e-9)')} AS ratio, sum(n)::BIGINT AS observed FROM rates GROUP BY GROUPING SETS ((model, mark), (model))")
def ratio(spark, sf):
    return pp.count_ratio(rates(spark, sf), ["model"]).select("model", "mark", r6("ratio").alias("ratio"), "observed")


@query("process_observed_over_expected", f"WITH {IV} SELECT CASE WHEN trace % 2 = 0 THEN 'even' ELSE 'odd' END AS split, mark, {q6('sum(n) / greatest(sum(rate * dt), 1e-9)')} AS observed_over_expected FROM rates WHERE model = 'cyclic' GROUP BY ALL")
def ooe(spark, sf):
    r = rates(spark, sf).filter("model = 'cyclic'").withColumn("split", F.when(F.col("trace") % 2 == 0, "even").otherwise("odd"))
    return pp.observed_over_expected(r, "split").withColumn("observed_over_expected", r6("observed_over_expected"))


@query("process_clip_audit", f"""WITH {IV}, s AS (SELECT model, trace, rate * 1.5e6 AS rate FROM rates), p AS (SELECT model, trace, count(*) AS v, count(*) FILTER (rate > 20) AS a20, count(*) FILTER (rate > 30) AS a30, max(rate) AS m, quantile_cont(rate, 0.999) AS q FROM s GROUP BY ALL)
SELECT model, sum(v)::BIGINT AS values, sum(a20)::BIGINT AS above_20, sum(a30)::BIGINT AS above_30, {q6('max(m)')} AS max_rate, {q6('max(q)')} AS p999_rate, {q6('sum(a20) / sum(v)')} AS fraction_above_20, {q6('sum(a30) / sum(v)')} AS fraction_above_30 FROM p GROUP BY model""")
def clip_audit(spark, sf):
    got = pp.clip_audit(rates(spark, sf).withColumn("rate", F.col("rate") * 1.5e6), ["model"])
    return got.withColumns({c: r6(c) for c in ("max_rate", "p999_rate", "fraction_above_20", "fraction_above_30")})


@query("process_clip_rates", f"WITH {IV} SELECT trace, i, mark, {q6('least(greatest(rate * 1.5e6, 1e-6), 30)')} AS rate FROM rates WHERE model = 'cyclic'")
def clip(spark, sf):
    return rates(spark, sf).filter("model = 'cyclic'").select("trace", "i", "mark", r6(pp.clip_rates(F.col("rate") * 1.5e6)).alias("rate"))


FE = ("dt", "n_error", "n_click")


@query("process_normalizer_fit", f"""WITH {IV} SELECT feature, {q6('avg(x)', 5)} AS mean, {q6('CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END', 5)} AS sd FROM (SELECT dt, n_error::DOUBLE AS n_error, n_click::DOUBLE AS n_click FROM iv) UNPIVOT (x FOR feature IN (dt, n_error, n_click)) GROUP BY feature""")
def normalizer(spark, sf):
    return pp.normalizer(intervals(spark, sf), FE).withColumns({"mean": r6("mean", 5), "sd": r6("sd", 5)})


@query("process_normalize", f"WITH {IV}, f AS (SELECT avg(dt) AS m, stddev_pop(dt) AS s, avg(n_click) AS mc, stddev_pop(n_click) AS sc FROM iv) SELECT trace, i, {q6('(dt - m) / s', 5)} AS dt, {q6('(n_click - mc) / sc', 5)} AS n_click FROM iv, f")
def normalize(spark, sf):
    iv = intervals(spark, sf)
    return pp.normalize(iv, FE, pp.normalizer(iv, FE)).select("trace", "i", r6("dt", 5).alias("dt"), r6("n_click", 5).alias("n_click"))


COMP = """cm AS (SELECT *, sum(rate * dt) OVER (PARTITION BY model, trace, mark ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM rates),
 fst AS (SELECT model, trace, mark, min_by(rate, t) AS r0, min(t) AS t0 FROM rates GROUP BY ALL),
 cv AS (SELECT e.model, e.trace, e.mark, e.t, CASE WHEN cm.t IS NULL THEN r0 * (e.t - t0) ELSE coalesce(c, 0) + cm.rate * (e.t - cm.t) END AS v FROM (SELECT fst.*, ev.t FROM fst JOIN (SELECT DISTINCT trace, mark, t FROM ev) ev USING (trace, mark)) e
   ASOF LEFT JOIN cm ON cm.model = e.model AND cm.trace = e.trace AND cm.mark = e.mark AND e.t >= cm.t),
 ci AS (SELECT model, trace, mark, t, v - lag(v) OVER (PARTITION BY model, trace, mark ORDER BY t) AS x FROM cv)"""


@query("process_compensator_increments", f"WITH {IV}, {COMP} SELECT model, trace, mark, {q6('t')} AS t, {q6('x')} AS increment FROM ci WHERE x IS NOT NULL")
def compensator(spark, sf):
    return pp.compensator_increments(rates(spark, sf), events(spark, sf), H, model=["model"]).withColumns({"t": r6("t"), "increment": r6("increment")})


KS = """us AS (SELECT model, mark, 1 - exp(-x) AS u FROM ci WHERE x IS NOT NULL), kr AS (SELECT model, mark, u, row_number() OVER (PARTITION BY model, mark ORDER BY u) AS j, count(*) OVER (PARTITION BY model, mark) AS n FROM us),
 ks AS (SELECT model, mark, max(n) AS n, max(greatest(j / n - u, u - (j - 1) / n)) AS ks FROM kr GROUP BY ALL)"""


@query("process_time_rescaling_test", f"WITH {IV}, {COMP}, {KS} SELECT model, mark, n, {q6('ks')} AS ks FROM ks")
def rescaling(spark, sf):
    inc = pp.compensator_increments(rates(spark, sf), events(spark, sf), H, model=["model"])
    return pp.ks_uniform(inc, ["model", "mark"]).select("model", "mark", "n", r6("ks").alias("ks"))


@query("process_interval_overlaps", f"""WITH {IV}, sp AS (SELECT trace, event_id AS span_id, coalesce(lag(t) OVER (PARTITION BY trace ORDER BY t), 0) AS s, t AS e FROM ev)
SELECT sp.trace, span_id, o.i, {q6('least(e, nt) - greatest(s, o.t)')} AS overlap FROM sp JOIN o ON sp.trace = o.trace AND o.t < e AND nt > s WHERE least(e, nt) - greatest(s, o.t) > 0""")
def overlaps(spark, sf):
    from .. import ordered

    b = base(spark, sf).filter(F.col("event_type").isin(*MARKS)).select(F.col("user_id").alias("trace"), F.col("event_id").alias("span_id"), F.col("t").alias("end"))
    spans = ordered.scan(b, ["trace"], ["end"], {"start": ordered.rlag("end", 0.0)})
    return pp.interval_overlaps(spans, pp.interval_dt(obs(spark, sf), H)).withColumn("overlap", r6("overlap"))


SP = """fl AS (SELECT iv.*, i = 0 OR ('0x' || substr(md5(concat_ws('|', 5, trace, i)), 1, 8))::BIGINT / 4294967296.0 < 0.45 AS k0 FROM iv), fn AS (SELECT *, count(*) FILTER (k0) OVER (PARTITION BY trace) AS kept, count(*) OVER (PARTITION BY trace) AS n FROM fl),
 fk AS (SELECT *, k0 OR (kept < 2 AND i = least(n - 1, greatest(1, n // 2))) AS keep FROM fn), fg AS (SELECT *, sum(keep::INT) OVER (PARTITION BY trace ORDER BY i) - 1 AS g FROM fk),
 mg AS (SELECT trace, g AS i, min(t) AS t, sum(dt) AS dt, sum(n_error)::BIGINT AS n_error, sum(n_purchase)::BIGINT AS n_purchase, sum(n_click)::BIGINT AS n_click, sum((n_error + 0.5) / (dt + 3600) * dt) / sum(dt) AS r FROM fg GROUP BY ALL)"""


@query("process_sparsify_flags", f"WITH {IV}, {SP} SELECT trace, i, keep FROM fk")
def flags(spark, sf):
    return pp.sparsify_flags(intervals(spark, sf), 0.45, 5).select("trace", "i", "keep")


@query("process_merge_intervals", f"WITH {IV}, {SP} SELECT trace, i::BIGINT AS i, {q6('t')} AS t, {q6('dt')} AS dt, n_error, n_purchase, n_click, {q6('r * 1e6', 5)} AS rate_per_million FROM mg")
def merge(spark, sf):
    iv = intervals(spark, sf).withColumn("r", (F.col("n_error") + 0.5) / (F.col("dt") + 3600))
    got = pp.merge_intervals(pp.sparsify_flags(iv, 0.45, 5), MARKS, ["r"])
    return got.select("trace", "i", r6("t").alias("t"), r6("dt").alias("dt"), "n_error", "n_purchase", "n_click", r6(F.col("r") * 1e6, 5).alias("rate_per_million"))


@query("process_sparsify_trace", f"WITH {IV}, {SP} SELECT trace, i::BIGINT AS i, n_error, {q6('coalesce(lag(n_error) OVER w / greatest(lag(dt) OVER w, 1e-6), 0)', 9)} AS lag_rate_error, coalesce(lag(n_click) OVER w, 0) AS lag_n_click FROM mg WINDOW w AS (PARTITION BY trace ORDER BY i)")
def sparsify(spark, sf):
    return pp.sparsify_trace(intervals(spark, sf), MARKS, 0.45, 5).select("trace", "i", "n_error", r6("lag_rate_error", 9).alias("lag_rate_error"), "lag_n_click")


@query("process_evaluate_rates", f"""WITH {IV}, {COMP}, {KS}, c AS (SELECT model, trace, i, sum(rate * dt - n * ln(greatest(rate, 1e-8))) AS l FROM rates GROUP BY ALL), n AS (SELECT model, avg(l) AS l, count(*) AS intervals FROM c GROUP BY model),
 r AS (SELECT model, avg(abs(rate - true_rate)) AS mae, sum(rate * dt) / greatest(sum(n), 1e-9) AS cr FROM rates GROUP BY model), k AS (SELECT model, max(ks) AS worst FROM ks GROUP BY model)
SELECT model, intervals, {q6('l')} AS nll_per_interval, {q6('mae * 1e6', 4)} AS rate_mae, {q6('cr')} AS count_ratio, {q6('worst')} AS worst_ks FROM n JOIN r USING (model) JOIN k USING (model)""")
def evaluate(spark, sf):
    got = pp.evaluate_rates(rates(spark, sf), events(spark, sf), H)
    return got.select("model", "intervals", r6("nll_per_interval").alias("nll_per_interval"), r6(F.col("rate_mae") * 1e6, 4).alias("rate_mae"), r6("count_ratio").alias("count_ratio"), r6("worst_ks").alias("worst_ks"))


@query("process_paired_nll", f"""WITH {IV}, l AS (SELECT model, trace, sum(rate * dt - n * ln(greatest(rate, 1e-8))) / count(DISTINCT i) AS l FROM rates GROUP BY ALL), d AS (SELECT trace, a.l - b.l AS d FROM l a JOIN l b USING (trace) WHERE a.model = 'cyclic' AND b.model = 'constant'),
 {draws_sql('d', 'd', [], ['trace'], [])}
SELECT {q6('(SELECT avg(d) FROM d)')} AS mean, {q6('quantile_cont(draw_mean, 0.025)')} AS lo, {q6('quantile_cont(draw_mean, 0.975)')} AS hi, (SELECT count(*) FROM d) AS n, {q6('(SELECT avg((d < 0)::INT) FROM d)')} AS better_fraction FROM draws""")
def paired(spark, sf):
    got = pp.paired_nll(rates(spark, sf), "cyclic", "constant", B, SEED)
    return got.withColumns({c: r6(c) for c in ("mean", "lo", "hi", "better_fraction")})


@query("process_windowed_counts", """SELECT time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS end, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase,
 count(*) FILTER (event_type = 'click') AS n_click FROM events GROUP BY ALL""")
def windowed(spark, sf):
    e = table(spark, sf, "events").select("ts", F.col("event_type").alias("mark"))
    return pp.windowed_counts(e, "ts", "6 hours", MARKS)
