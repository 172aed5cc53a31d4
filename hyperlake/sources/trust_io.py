"""Trust cells to and from JSON text, and event logs to and from Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: folders of an event log
RUN_BUCKETS = 64

CELL_SCHEMA = (
    "estimand STRING, intervention STRING, regime STRING, alpha DOUBLE, objective_by_alpha MAP<STRING,DOUBLE>, mae_by_alpha MAP<STRING,DOUBLE>, "
    "predictive_nmae_by_alpha MAP<STRING,DOUBLE>, inadequacy BOOLEAN, n_scenarios BIGINT, calibration_horizon DOUBLE"
)


def cells_to_json(cells: DataFrame) -> DataFrame:
    """One JSON document per cell (a trust field is a lookup table, not one blob)."""
    cols = [c.split(" ")[0] for c in CELL_SCHEMA.split(", ")]
    return cells.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def cells_from_json(lines: DataFrame, grid: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)) -> DataFrame:
    """Cells with ``problem`` where the alpha is outside the grid or the text is no cell."""
    c = lines.select(F.from_json("value", CELL_SCHEMA).alias("c")).select("c.*")
    return c.withColumn("problem", F.when(F.col("alpha").isNull(), "not_a_cell").when(~F.col("alpha").isin(*grid), "alpha_outside_grid"))


def write_event_log(events: DataFrame, path: str) -> None:
    """Parquet with the digest of each record's canonical JSON, runs dealt over a fixed number of folders.

    A filter on ``run_id`` together with :func:`run_bucket` reads one folder; there is no folder for each run.
    """
    marked = events.withColumn("record_sha256", _record_digest(events.columns)).withColumn("run_bucket", run_bucket(F.col("run_id")))
    marked.write.mode("overwrite").partitionBy("run_bucket").parquet(path)


def run_bucket(run_id: Column) -> Column:
    """The folder of a run."""
    return F.pmod(F.xxhash64(run_id.cast("string")), F.lit(RUN_BUCKETS)).cast("int")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with ``intact``: whether each record still has its stored digest."""
    df = spark.read.parquet(path)
    own = [c for c in df.columns if c not in ("record_sha256", "run_bucket")]
    return df.withColumn("intact", _record_digest(own) == F.col("record_sha256")).drop("run_bucket")


def _record_digest(columns: list[str]):
    cols = [F.col(c).cast("string").alias(c) if c == "run_id" else F.col(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*cols)), 256)
