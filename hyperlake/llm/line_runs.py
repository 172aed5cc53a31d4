"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed, sorted table ``h1, h2, n_docs, last_doc``: in how many documents
of the batches behind it a line occurs, and the largest ``doc_id`` among them.
Documents come in batches of falling ``doc_id``.  A new batch is merge-anti-joined
with every run: lines that a run already shows to be frequent are settled (their
count is sufficient and their last document is in an earlier batch), so they leave the
batch before it is counted.  What remains is counted and becomes a run of level 0.
``fan_in`` runs of one level are compacted into one of the next, so there are only
logarithmically many.  Runs share one bucketing, so a join with a run never shuffles it.

Lines are told apart by 128 bits: two differently seeded 64-bit hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import BLANKS, ascii_lower, cut, fresh, shared_dir

HASHES = ["h1", "h2"]


class LineRuns:
    """Levels of sorted runs; add batches in falling order of ``doc_id``."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 2, buckets: int | None = None) -> None:
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.names: list[str] = []

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def _write(self, counted: DataFrame) -> str:
        name = f"hyperlake_line_run_{uuid.uuid4().hex}"
        sorted_run = counted.repartition(self.buckets, *HASHES).write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES)
        sorted_run.option("path", self._path(name)).saveAsTable(name)
        self.names.append(name)
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        # Spark takes a union of bucketed scans for partitioned, but reads their buckets one after the other: counts of
        # one line would not meet.  So runs are merged from their files, without the buckets.
        files = self.spark.read.schema(self.spark.table(runs[0]).schema).parquet(*[self._path(run) for run in runs])
        return files.groupBy(*HASHES).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch: ``h1, h2, doc_id``, each line once for each document that has it."""
        counted = lines.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        runs = [run for level in self.levels for run in level]
        counted = counted.repartition(self.buckets, *HASHES)
        for run in runs:
            counted = counted.join(self.spark.table(run).filter(F.col("n_docs") >= self.min_docs), HASHES, "left_anti")
        self.levels[0].append(self._write(counted))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(self.levels[k])))
                self.levels[k] = []

    def frequent(self) -> DataFrame:
        """``h1, h2, last_doc`` of all lines in at least ``min_docs`` documents; ends the use of the runs."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, last_doc long")
        out = cut(self._merged(runs).filter(F.col("n_docs") >= self.min_docs).select(*HASHES, "last_doc"))
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.levels = [], [[]]
        return out


def line_key(line: Column) -> Column:
    """What makes two lines equal: the line without blanks at both ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def n_chars(text: str) -> Column:
    """Characters of a text column; null stays null."""
    return F.char_length(F.col(text)).cast("long")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan_in: int = 2,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with frequent lines cut from ``text``, and ``n_lines`` (before) and ``n_dropped`` added.

    A line whose key has at least ``min_chars`` characters and occurs in at least
    ``min_docs`` documents stays only in the document with the largest ``doc_id`` that
    has it (there with all its repeats).  All other lines stay, joined by newlines.

    A null or empty text is one empty line and stays as it is.  A null ``doc_id`` is
    smaller than all others.  Rows that share a ``doc_id`` each count as a document and
    keep and lose the same lines.  A text whose lines all go becomes empty.  Columns of
    ``docs`` named like the two counts are replaced; all others pass through.  ``docs``
    is read twice.
    """
    spark = docs.sparkSession
    key, h1, h2, ident, drops = F.col("k"), F.xxhash64("k"), F.xxhash64(F.lit(1), F.col("k")), "doc_id", "_drops"
    keys = F.filter(F.transform(_lines(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars)
    rows = docs.select(F.col(doc_id).alias(ident), F.explode(F.array_distinct(keys)).alias("k")).select(h1.alias("h1"), h2.alias("h2"), ident)
    cuts = docs.select(F.percentile_approx(doc_id, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    batch = F.lit(0)
    for k, bound in enumerate(sorted(set(cuts))):
        batch = F.when(F.col(ident) > bound, F.lit(-k - 1)).otherwise(batch)
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", IntegerType())])).parquet(path)
    runs = LineRuns(spark, min_docs, fan_in)
    for b in range(-len(set(cuts)), 1):
        runs.add(rows.filter(F.col("batch") == b).drop("batch"))
    doomed = rows.join(runs.frequent(), HASHES).filter(~F.col(ident).eqNullSafe(F.col("last_doc")))
    mark, drops = fresh(docs, "_doc", "_drops")
    doomed = doomed.groupBy(F.col(ident).alias(mark)).agg(F.collect_set("h1").alias(drops))
    joined = docs.drop(*[c for c in (n_lines, n_dropped) if c in docs.columns]).join(doomed, docs[doc_id].eqNullSafe(doomed[mark]), "left")
    lines, kept = fresh(joined, "_lines", "_kept")
    joined = joined.withColumn(lines, _lines(F.col(text)))
    stays = lambda line: ~F.array_contains(F.col(drops), F.xxhash64(line_key(line)))
    joined = joined.withColumn(kept, F.when(F.col(drops).isNotNull(), F.filter(lines, lambda x: (F.char_length(x) < min_chars) | stays(x))))
    joined = joined.withColumns({
        n_lines: F.size(lines).cast("long"), n_dropped: F.when(F.col(drops).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long"),
        text: F.when(F.col(drops).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    })
    return joined.select(*[c for c in docs.columns if c not in (n_lines, n_dropped)], n_lines, n_dropped)
