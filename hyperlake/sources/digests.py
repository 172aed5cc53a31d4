"""Content digests, dataset fingerprints and freeze manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """name, sha256 and length of every file."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def row_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of a table, per key: row count and summed digest slices.

    Row digests are added slice by slice, which combines on the map side; no row
    order and no gathering is needed, and a changed, missing or repeated row
    changes the sums.
    """
    cols = list(columns or df.columns)
    d = df.withColumn("_d", row_digest(cols))
    piece = lambda i: F.sum(F.conv(F.substring("_d", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)"))
    got = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[piece(i).alias(f"_p{i}") for i in range(4)])
    return got.select(*keys, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def freeze_manifest(spark: SparkSession, constants: Mapping[str, Any], inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Protocol constants and input fingerprints as rows (item, value)."""
    rows = spark.createDataFrame([(k, repr(v)) for k, v in sorted(constants.items())], "item STRING, value STRING")
    for name, df in sorted(inputs.items()):
        rows = rows.unionByName(dataset_fingerprint(df).select(F.lit(f"input:{name}").alias("item"), F.col("fingerprint").alias("value")))
    return rows


def freeze_drift(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Items that changed, appeared or vanished since the freeze."""
    a, b = frozen.withColumnRenamed("value", "frozen"), current.withColumnRenamed("value", "current")
    return a.join(b, "item", "full_outer").filter(~F.col("frozen").eqNullSafe(F.col("current")))


class FreezeDriftError(ValueError):
    """Something changed after the freeze; ``drift`` is the table of all such items."""

    def __init__(self, drift: DataFrame) -> None:
        super().__init__("inputs or protocol differ from the frozen manifest; see the drift table")
        self.drift = drift


def require_freeze(frozen: DataFrame, current: DataFrame) -> None:
    """Raise when anything drifted."""
    drift = freeze_drift(frozen, current)
    if not drift.isEmpty():
        raise FreezeDriftError(drift)
