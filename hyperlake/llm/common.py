"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, passing_cuts, shared_dir

#: what separates words: space, tab, newline, vertical tab, form feed, carriage return
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["BLANKS", "ascii_lower", "components", "cut", "fresh", "held_out", "passing_cuts", "same", "share_of", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` is used where a text has only one-byte characters: there it means the same and is much cheaper.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the third that no classifier may learn from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def share_of(key: Column, wanted: int, total: int) -> Column:
    """True for about ``wanted`` of ``total`` keys, chosen by a hash; for all when there are no more.

    Unlike a sorted limit this gathers nothing beyond the chosen rows, however many tasks read the table.
    """
    top = 1 << 30
    return F.pmod(F.xxhash64(F.lit(29), key), F.lit(top)) < F.lit(top if total <= wanted else int(top * wanted / total))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  A node hands
    its larger neighbours, then its smaller ones, to its smallest neighbour, so a
    round never makes more links than it got and a hub is a star, not a clique.  Each
    round is one combined minimum (partial on the map side) and one join that the
    planner may split; its links are written to the shared folder.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: of each node u, larger neighbours v link to the least of u and its neighbours
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct())
        # small star: of each node u, smaller neighbours and u itself link to the least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        # two sums tell whether a round changed anything; wrapping is harmless
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return cut(stars.union(stars.select(F.col("root").alias("node"), "root").distinct()))


def same(keys: Sequence[str], other: Sequence[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    out = F.lit(True)
    for a, b in zip(keys, other, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out
