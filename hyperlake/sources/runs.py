"""Run tables: reading, sharding, resuming and design audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARM_KEY = ("regime", "scenario", "replicate", "model", "policy")

RUN_SCHEMA = (
    "regime STRING, scenario BIGINT, replicate INT, model STRING, policy STRING, trust DOUBLE, goal_utility_ratio DOUBLE, "
    "critical_success_rate DOUBLE, mean_latency DOUBLE, energy DOUBLE, events BIGINT, outages BIGINT, handovers BIGINT, "
    "reroutes BIGINT, seed STRING, final_hash STRING, thinning_rejections BIGINT"
)
REQUIRED = ("regime", "scenario", "replicate", "model", "policy", "trust", "goal_utility_ratio", "critical_success_rate", "mean_latency")


def by_layout(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, list[str]]]:
    """The header lines of the files of a path or glob, each with its files.

    One pass over the first blocks finds the first line of every file; only headers and file names come to the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    heads = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    found = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    # Spark reports file names as encoded URIs
    return [(r["header"], [unquote(f) for f in r["files"]]) for r in found]


def read_run_table(spark: SparkSession, path: str | Sequence[str], required: Sequence[str] = REQUIRED, schema: str = RUN_SCHEMA) -> DataFrame:
    """CSV run table of a file, a glob or several: headers checked against ``required``, columns typed by name; ``problem`` names malformed values.

    Shards may order their columns differently or lack some (null then): files are grouped by header, and no file is read
    by position of another.  Row order is left to whoever writes the result, see :func:`canonical_order`.
    """
    layouts = by_layout(spark, path)
    if not layouts:
        raise ValueError("a run table without a header")
    parts = [spark.read.option("header", True).option("enforceSchema", False).csv(files) for _, files in layouts]
    missing = sorted({c for p in parts for c in set(required) - set(p.columns)})
    if missing:
        raise ValueError(f"run table is missing columns: {missing}")
    raw = union_shards(parts)
    types = dict(part.strip().split(" ") for part in schema.split(","))
    typed = {c: F.col(c).try_cast(types[c]) for c in raw.columns if c in types}
    lost = F.filter(F.array(*[F.when(F.col(c).isNotNull() & x.isNull(), F.lit(c)) for c, x in typed.items()]), lambda c: c.isNotNull())
    problem = F.when(F.size(lost) > 0, F.concat(F.lit("malformed: "), F.array_join(lost, ", ")))
    return raw.select(*[typed.get(c, F.col(c)).alias(c) for c in raw.columns], problem.alias("problem"))


def canonical_order(df: DataFrame) -> DataFrame:
    """Range-sorted by the arm key, for sinks that want the canonical order."""
    return df.orderBy(*ARM_KEY)


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Concatenate shards by column name; columns absent from a shard are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def dedup_keep_last(df: DataFrame, keys: Sequence[str], shard: str) -> DataFrame:
    """The row of the latest shard per arm key.

    A max over the whole row combines on the map side, so copies of one key are
    reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != shard]
    # of two rows of one shard the larger one counts, so the choice does not depend on their order
    got = df.groupBy(*keys).agg(F.max(F.struct(shard, *rest)).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def planned(units: DataFrame, levels: Mapping[str, DataFrame], factors: Mapping[str, Sequence[str]]) -> DataFrame:
    """The planned factorial: units x the distinct levels x declared factor values.

    Levels are folded into one array of distinct values each (the levels of a
    design factor, a bounded set) and unfolded on every unit.
    """
    out = units.withColumn("_k", F.lit(1))
    for name, df in levels.items():
        folded = df.select(name).distinct().agg(F.array_sort(F.collect_set(name)).alias(f"_{name}")).withColumn("_k", F.lit(1))
        out = out.join(folded, "_k").withColumn(name, F.explode(f"_{name}")).drop(f"_{name}")
    for name, values in factors.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("_k")


def missing_arms(plan: DataFrame, done: DataFrame, keys: Sequence[str] = ARM_KEY) -> DataFrame:
    """Planned arms that have no row yet."""
    return plan.select(*keys).join(done.select(*keys), list(keys), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ARM_KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def seed_audit(df: DataFrame, unit: Sequence[str] = ("regime", "scenario", "replicate")) -> DataFrame:
    """Units whose arms did not all run from one seed."""
    return df.groupBy(*unit).agg(F.count_distinct("seed").alias("seeds")).filter(F.col("seeds") != 1)


def design_audit(df: DataFrame) -> DataFrame:
    """One row: totals, duplicate arm keys, factor levels, distinct final hashes."""
    arms = df.groupBy(*ARM_KEY).agg(F.count(F.lit(1)).alias("_c"), F.sum("events").alias("_e"), F.sum("thinning_rejections").alias("_t"))
    totals = arms.agg(
        F.sum("_c").alias("rows"), (F.sum("_c") - F.count(F.lit(1))).alias("duplicate_arm_keys"),
        F.sum("_e").alias("accepted_events"), F.sum("_t").alias("thinning_rejections"), F.lit(1).alias("_k"),
    )
    levels = df.agg(*[F.count_distinct(c).alias(f"{c}s" if c != "policy" else "policies") for c in ("regime", "model", "policy")], F.lit(1).alias("_k"))
    # distinct hashes are counted by a shuffle, not gathered
    hashes = df.select("final_hash").distinct().agg(F.count(F.lit(1)).alias("unique_state_hashes"), F.lit(1).alias("_k"))
    return totals.join(levels, "_k").join(hashes, "_k").drop("_k")
