"""Inputs the registered queries derive from the given tables, and their SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..effects_names import ARMS, POLICIES


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def q6(expr: str, digits: int = 6) -> str:
    """SQL rounding that also turns negative zero into zero, as Spark's round does."""
    return f"(round({expr}, {digits}) + 0.0)"


# --- run table ---------------------------------------------------------------

METRICS = ("goal_utility_ratio", "critical_success_rate", "mean_latency")
COUNTS = ("events", "outages", "handovers", "reroutes")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per executed arm, averaged from the order lines that fall into it."""
    li = table(spark, sf_dir, "lineitem")
    arm = F.element_at(F.array(*[F.lit(a) for a in ARMS]), (F.col("l_partkey") % 5 + 1).cast("int"))
    policy = F.when(F.col("l_orderkey") % 2 == 0, POLICIES[0]).otherwise(POLICIES[1])
    keyed = li.select(
        F.col("l_returnflag").alias("regime"),
        (F.col("l_suppkey") % 20).alias("scenario"),
        (F.col("l_linenumber") % 2).alias("replicate"),
        arm.alias("model"),
        policy.alias("policy"),
        "l_quantity", "l_discount", "l_tax", "l_linestatus",
    )
    trust = F.create_map(*[F.lit(x) for a, t in ARMS.items() for x in (a, t)])
    return (
        keyed.groupBy("regime", "scenario", "replicate", "model", "policy")
        .agg(
            F.avg("l_quantity").alias("goal_utility_ratio"),
            F.avg("l_discount").alias("critical_success_rate"),
            F.avg("l_tax").alias("mean_latency"),
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("l_linestatus") == "O").alias("outages"),
            F.count_if(F.col("l_quantity") > 25).alias("handovers"),
            F.count_if(F.col("l_tax") > 0.04).alias("reroutes"),
            F.count_if(F.col("l_discount") > 0.05).alias("thinning_rejections"),
        )
        .withColumn("trust", trust[F.col("model")])
    )


RUNS = """runs AS (
  SELECT regime, scenario, replicate, model, policy,
         avg(l_quantity) AS goal_utility_ratio, avg(l_discount) AS critical_success_rate, avg(l_tax) AS mean_latency,
         count(*) AS events, count(*) FILTER (l_linestatus = 'O') AS outages,
         count(*) FILTER (l_quantity > 25) AS handovers, count(*) FILTER (l_tax > 0.04) AS reroutes,
         count(*) FILTER (l_discount > 0.05) AS thinning_rejections,
         CASE model WHEN 'oracle' THEN NULL WHEN 'mechanistic_calibrated' THEN 0.0::DOUBLE WHEN 'residual_quarter' THEN 0.25::DOUBLE
              WHEN 'residual_idcal' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS trust
  FROM (SELECT l_returnflag AS regime, l_suppkey % 20 AS scenario, l_linenumber % 2 AS replicate,
               (['oracle','mechanistic_calibrated','residual_quarter','residual_idcal','residual_predictive'])[l_partkey % 5 + 1] AS model,
               CASE WHEN l_orderkey % 2 = 0 THEN 'throughput' ELSE 'semantic' END AS policy,
               l_quantity, l_discount, l_tax, l_linestatus FROM lineitem)
  GROUP BY ALL)"""

# effect per (regime, scenario, model, estimand), long form
EFFECTS = RUNS + """,
long AS (SELECT regime, scenario, model, trust, policy, estimand, value FROM runs
  UNPIVOT (value FOR estimand IN (goal_utility_ratio, critical_success_rate, mean_latency))),
effects AS (SELECT estimand, regime, scenario, model, trust,
    avg(value) FILTER (policy = 'semantic') AS semantic, avg(value) FILTER (policy = 'throughput') AS throughput,
    avg(value) FILTER (policy = 'semantic') - avg(value) FILTER (policy = 'throughput') AS effect
  FROM long GROUP BY ALL),
arm_errors AS (SELECT a.estimand, a.regime, a.scenario, a.model, a.trust AS alpha, a.effect, o.effect AS oracle_effect,
    abs(a.effect - o.effect) AS abs_error
  FROM effects a JOIN effects o USING (estimand, regime, scenario) WHERE a.model <> 'oracle' AND o.model = 'oracle')"""
