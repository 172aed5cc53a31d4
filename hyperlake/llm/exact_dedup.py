"""Exact duplicates with a heavy-hitter split.

Copies of one text may be a third of all rows, and a shuffle on the digest would
bring them all into one task.  So digests are looked at twice:

1. *Misra-Gries* summaries, one per partition, are added up.  With ``counters``
   counters each summary misses at most ``rows / (counters + 1)`` occurrences of a
   digest, so every digest in more than ``2 / counters`` of all rows is a candidate,
   and there are at most ``counters`` candidates however large the table is.
2. The candidates are counted exactly (a combined sum on the map side): these are
   the *verified winners*, and their table, bounded by ``counters`` rows, is broadcast.
   Rows of winners get their answer in place.  All other digests are shuffled; each
   has at most ``2 / counters`` of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

COUNTERS = 2048


def _summaries(counters: int):
    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = pd.Series(dtype="int64"), 0
        for batch in batches:
            rows += len(batch)
            kept = kept.add(batch["digest"].value_counts(), fill_value=0).astype("int64")
            if len(kept) > counters:
                # the step of the algorithm that lets go of the least: what the first counter beyond the limit holds goes from all
                kept = kept.nlargest(counters + 1)
                kept = kept - kept.iloc[-1]
                kept = kept[kept > 0]
        if rows:
            yield pd.DataFrame({"digest": [None, *kept.index], "n": [rows, *kept.to_numpy()]})

    return summarize


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest: at most ``counters`` values, with every one found in over ``2 / counters`` of the rows."""
    parts = cut(digests.select("digest").mapInPandas(_summaries(counters), "digest string, n long"))
    rows = parts.filter("digest is null").agg(F.sum("n")).first()[0] or 0
    # the summed counts of all digests are at most ``rows``, so at most ``counters`` reach this
    return parts.filter("digest is not null").groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") * counters > rows).select("digest")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalize: Column | None = None, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of equal texts the row with the largest ``doc_id`` stays (``keep_id``; null ids are
    the smallest).  ``normalize`` is the text that is compared, the text as it is when
    left out.  A null text counts as empty, so null and empty texts are one group.
    Rows that repeat a text and a ``doc_id`` cannot be told apart: each counts in
    ``group_size`` and all carry the same ``kept``.  Other columns are not read, whatever
    their names.  An empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text) if normalize is None else normalize, F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(whole.cast("binary"), 256).alias("digest")))
    hot = frequent(rows, counters)
    winners = cut(rows.join(F.broadcast(hot), "digest").groupBy("digest").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")))
    marked = rows.join(F.broadcast(winners), "digest", "left")
    there = F.col("_size").isNotNull()
    by = Window.partitionBy("digest")
    rest = marked.filter(~there).withColumns({"_keep": F.max("doc_id").over(by), "_size": F.count(F.lit(1)).over(by)})
    return marked.filter(there).unionByName(rest).select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kid, digest = fresh(docs, "_kept_id", "_kept_digest")
    kept = exact_groups(docs, doc_id, text, counters=counters).filter("kept").select(F.col("doc_id").alias(kid), F.col("text_sha256").alias(digest)).distinct()
    own = F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256)
    return docs.join(kept, docs[doc_id].eqNullSafe(kept[kid]) & (own == kept[digest]), "left_semi")
