"""Session helpers: a tuned local session for tests and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "hyperlake", memory: str = "12g", shared: str | None = None) -> SparkSession:
    """A session for tests and the bench with its folder for cuts; a cluster brings its own."""
    shared = shared or tempfile.mkdtemp(prefix="hyperlake-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("HYPERLAKE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's own subfolder of the shared folder ``spark.checkpoint.dir`` names.

    Everything a session cuts lies under this one subfolder, so it can be dropped as
    a whole.  Without a named folder only a ``local[...]`` session gets a scratch
    folder: on a cluster each executor would write to its own disk, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        named = getattr(spark, "_hyperlake_dir", None)
        if named is None:
            named = spark._hyperlake_dir = tempfile.mkdtemp(prefix="hyperlake-")
    return f"{named.rstrip('/')}/hyperlake-{spark.sparkContext.applicationId}"


#: paths of the cuts of each open :func:`passing_cuts`, the innermost last
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("_passing", default=())


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """Cuts made in this block leave the shared folder when it ends, so nothing that is used later may read them.

    A cut that ``stays`` belongs to the block around this one, or is left in the folder when there is none.  A block that
    raises leaves its cuts.
    """
    mine: list[str] = []
    token = _passing.set((*_passing.get(), mine))
    try:
        yield
    finally:
        _passing.reset(token)
    for path in mine:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, stays: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back without its lineage.

    The files outlive any executor, so a lost executor costs a re-read and never a
    recomputation of what led here.  Parquet keeps column pruning and sizes, so
    small results can still be broadcast where the planner sees fit.  They outlive the
    session too, unless a block of :func:`passing_cuts` ends their use.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    open_ = _passing.get()[:-1] if stays else _passing.get()
    if open_:
        open_[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
