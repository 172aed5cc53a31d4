"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often the mix takes it.  Of all rates that meet the
token target of each source, those are chosen that stay closest to one in (weighted)
entropy: with document size ``s``, mean size ``m`` of its source and weight ``s + m``,

    minimise  sum_i (s_i + m) * (r_i log r_i - r_i + 1)   subject to   sum_i s_i r_i = target,   0 <= r_i <= cap,

whose solution is an exponential tilt ``r_i = min(cap, exp(lambda * s_i / (s_i + m)))``.
``lambda`` solves the convex dual, one number per source.  All sources take a Newton
step at a time: one grouped sum over the distinct sizes gives gradient and curvature,
and a bracket catches steps that leave it.

Rates become copies by error diffusion from the largest document to the smallest, so
what is owed at the end is about half the smallest document.  A large source is dealt
into parts by a hash first; each part is rounded to its own share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import rnumber, scan
from .common import cut, fresh, same

#: documents of a source that are rounded together
ROWS_PER_PART = 4096


def word_count(text: Column) -> Column:
    """How many runs of other than ASCII blanks a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``source, n, source_size, target`` from ``source, size``.

    Sources in order of code points, null last, take ``weights`` in turn and share the sum of all sizes; a target stops
    at ``cap`` times its source's size, and what is above goes to the others by weight until none is above.
    """
    sums = cut(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()))
    turn = scan(sums, [], ["last", "source"], {"at": rnumber()})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    rows = cut(turn.select("source", "n", "source_size", weight.alias("weight")))
    most, share, full = F.col("source_size") * F.lit(float(cap)), 0.0, None
    while True:
        above = most < F.col("weight") * F.lit(share)
        got = rows.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, most).otherwise(0.0)).alias("taken"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(above).alias("full"),
        ).first()
        if got["full"] == full or not got["open"]:
            break
        full, share = got["full"], ((got["total"] or 0) - got["taken"]) / got["open"]
    return rows.select("source", "n", "source_size", F.least(most, F.col("weight") * F.lit(share)).alias("target"))


def tilt(size: Column, mean: Column, rate: Column, cap: float) -> Column:
    """The rate of a document: ``min(cap, exp(lambda * size / (size + mean)))``."""
    at = F.when(size > 0, size / (size + mean)).otherwise(0.0)
    return F.least(F.lit(float(cap)), F.exp(F.least(rate * at, F.lit(50.0))))


def balance(sizes: DataFrame, targets: DataFrame, cap: float = 3.0, tolerance: float = 1e-10) -> DataFrame:
    """``source, n, source_size, target, mean, rate``: the dual solution ``rate`` (lambda) of every source.

    A source whose target is ``cap`` times its size has an infinite one.
    """
    counts = cut(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("source", "_source"))
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n")).otherwise(1.0)
    start = targets.select("source", "n", "source_size", "target", mean.alias("mean")).withColumns({
        "done": (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * F.lit(float(cap))), "low": F.lit(-math.inf), "high": (F.col("mean") + 1) * (math.log(cap) + 0.1),
    })
    state = cut(start.withColumn("rate", F.when(F.col("done") & (F.col("source_size") > 0), F.lit(math.inf)).otherwise(0.0)))
    while not state.filter(~F.col("done")).isEmpty():
        open_ = state.filter(~F.col("done")).select("source", "mean", "rate")
        r = tilt(F.col("size"), F.col("mean"), F.col("rate"), cap)
        mass = F.col("k") * F.col("size") * F.col("r")
        sums = counts.join(open_, same(["_source"], ["source"])).withColumn("r", r).groupBy("source").agg(
            F.sum(mass).alias("got"), F.sum(F.when(F.col("r") < cap, mass * F.col("size") / (F.col("size") + F.col("mean"))).otherwise(0.0)).alias("slope"),
        ).withColumnRenamed("source", "_s")
        step = state.join(sums, same(["source"], ["_s"]), "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("rate")).otherwise(F.col("low")), F.when(gap > 0, F.col("rate")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("rate") - gap / F.col("slope"))
        middle = F.when(F.col("_low") == F.lit(-math.inf), F.col("_high") * 2 - 1).otherwise((F.col("_low") + F.col("_high")) / 2)
        inside = newton.isNotNull() & (newton > F.col("_low")) & (newton < F.col("_high"))
        step = step.withColumns({"_low": low, "_high": high}).withColumn("_next", F.when(inside, newton).otherwise(middle))
        settled = (F.abs(gap) <= F.greatest(F.col("target"), F.lit(1.0)) * F.lit(tolerance)) | (F.col("_next") == F.col("rate"))
        state = cut(step.select(
            "source", "n", "source_size", "target", "mean", (F.col("done") | F.coalesce(settled, F.lit(True))).alias("done"),
            F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high"),
            F.when(F.col("done") | settled, F.col("rate")).otherwise(F.coalesce("_next", "rate")).alias("rate"),
        ))
    return state.drop("done", "low", "high")


def diffuse(size: np.ndarray, rate: np.ndarray, cap: int) -> np.ndarray:
    """Whole copies for documents in falling order of size; each pays what the larger ones left owing."""
    copies, owed = np.zeros(len(size), dtype=np.int64), 0.0
    for k, (s, r) in enumerate(zip(size.tolist(), rate.tolist(), strict=True)):
        low = int(r)
        if s <= 0:
            copies[k] = min(round(r), cap)
            continue
        want = r * s + owed
        c = min(max(round(want / s), low), low + (r > low), cap)
        copies[k], owed = c, want - c * s
    return copies


def _round(cap: int):
    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id"], ascending=False, na_position="last", kind="stable")
        # rows that repeat an id within its source and size are taken equally often
        part["copies"] = diffuse((part["size"] * part["k"]).to_numpy(), part["r"].to_numpy(), cap)
        return part[["doc_id", "source", "size", "copies"]]

    return one


def mix_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies`` for every row of ``docs``.

    A null text has size 0, a null source is a source of its own.  Documents of size 0 change no sum; they keep one copy
    (``cap`` in a source at its limit).  Rows that share id, source and size get equally many copies.  Other columns are
    not read.  The same table gives the same copies.  An empty table gives an empty table.
    """
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    solved = balance(rows, source_targets(rows, weights, cap), cap).withColumnsRenamed({"source": "_s", "rate": "_rate"})
    keyed = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("k")).join(solved, same(["source"], ["_s"]))
    r = F.when(F.col("_rate") == F.lit(math.inf), F.lit(float(cap))).otherwise(tilt(F.col("size"), F.col("mean"), F.col("_rate"), cap))
    parts = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / ROWS_PER_PART))
    dealt = keyed.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "k", r.alias("r"), parts.alias("part"))
    whole = dealt.groupBy("source", "part").applyInPandas(_round(cap), "doc_id string, source string, size long, copies long")
    whole = whole.select(F.col("doc_id").cast("long").alias("_d"), F.col("source").alias("_c"), F.col("size").alias("_z"), "copies")
    out = rows.join(whole, same(["doc_id", "source", "size"], ["_d", "_c", "_z"])).join(solved, same(["source"], ["_s"]))
    rate = F.when(F.col("_rate") == F.lit(math.inf), F.lit(float(cap))).otherwise(tilt(F.col("size"), F.col("mean"), F.col("_rate"), cap))
    return out.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as many times as its copies, with its own columns only."""
    d, s, z, c, own = fresh(docs, "_mix_doc", "_mix_source", "_mix_size", "_mix_copies", "_own_size")
    copies = mix_copies(docs, doc_id, text, source, weights, cap).filter("copies > 0").groupBy(
        F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z)).agg(F.max("copies").cast("int").alias(c))
    sized = docs.withColumn(own, word_count(F.col(text)))
    joined = sized.join(copies, same([doc_id, source, own], [d, s, z]))
    return joined.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)
