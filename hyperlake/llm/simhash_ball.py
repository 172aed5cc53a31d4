"""SimHash near-duplicates by meet-in-the-middle ball hashing, and near-duplicates that a similarity of texts defines.

Two fingerprints at most ``2 r`` bits apart have a variant in common that is at most
``r`` bits from either.  So every distinct fingerprint emits the whole ball of radius
``r`` around itself (65 variants for ``r = 1``), the variants are shuffled, and
fingerprints that meet in a variant are linked.  A variant can meet at most as many
distinct fingerprints as its own ball holds, so no bucket can become hot: copies and
near copies with one fingerprint were collapsed before.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, fresh, passing_cuts, share_of

SEED = 42
#: so many shingles are unpacked to bits at a time
BLOCK = 1 << 16


def majority_bits(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are those that more than half of the hashes have."""
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), BLOCK):
        h = np.ascontiguousarray(hashes[k : k + BLOCK]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint_of(text: str | None, words: int) -> int:
    """The signed 64-bit fingerprint of one text."""
    # on bytes, lower() and split() know the ASCII letters and blanks only
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return 0
    n = len(parts)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())]
    return majority_bits(np.array(hashes, dtype="<u8"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp``: the 64-bit SimHash over all shingles of ``words`` words of the whole text.

    Words are runs of other than ASCII blanks, with A-Z in lower case.  A text of fewer words is one shingle; one
    without words (null, empty, blanks) has fingerprint zero.
    """

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words) for t in texts], dtype=np.int64))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), of(F.col(text)).alias("fp"))


def ball(radius: int) -> list[int]:
    """All signed 64-bit masks with at most ``radius`` bits set."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def fingerprint_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """``a, b``: links that connect all distinct ``fp`` within ``bits`` bits of each other, directly or through others.

    In a bucket every fingerprint links to the next larger one.  Members of a bucket are within ``bits`` (twice the
    radius) of each other, so this chain keeps every bucket connected.  ``bits`` is even.
    """
    if bits % 2:
        raise ValueError("the balls of two fingerprints meet in the middle, so the distance is even")
    masks = F.array(*[F.lit(m) for m in ball(bits // 2)])
    variants = fps.select("fp").distinct().withColumn("_mask", F.explode(masks)).select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("variant"))
    pairs = variants.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("b")).filter("b is not null")
    pairs = pairs.select(F.col("fp").alias("a"), "b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def _grouped(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    grouped = components(links).withColumnRenamed("node", "fp")
    whole = cut(nodes.join(grouped, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = whole.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rows.join(whole.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``: the smallest ``doc_id`` reachable over links.

    Documents link when their fingerprints differ in at most ``bits`` bits; texts without words have fingerprint zero
    and link like any other.  A null ``doc_id`` is never a ``component_id`` unless all of its group are null.  Rows that
    repeat are grouped like any others.  Other columns are not read.  An empty table gives an empty table.
    """
    rows = cut(fingerprints(docs, doc_id, text, words))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    return _grouped(rows, nodes, fingerprint_links(nodes, bits))


# --- by similarity -----------------------------------------------------------


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of all shingles of a whole text, in order."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    shingles = [b" ".join(parts[k : k + words]) for k in range(max(len(parts) - words + 1, 1 if parts else 0))]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64).view(np.int64))


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; zero for none."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], dtype=np.uint64).view(np.int64)[0]) if len(shingles) else 0


def frequent_shingles(docs: DataFrame, text: str, words: int, texts: int = 4000, least: int = 3, most: int = 1 << 18, one_in: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, in order, and how many have them; at most ``most``, the most frequent.

    The sample is one in ``one_in`` texts, and ``texts`` at least.  It grows with the table, so that what it lacks is in a
    bounded number of texts: a sample of fixed size lacks what a fixed share of all texts have, whose pairs grow with the
    square of the table.  The order in which shingles are looked at is all they set: what the sample lacks costs time and
    loses no pair.
    """

    @F.pandas_udf("array<long>")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words) for t in column])

    total = docs.count()
    sample = docs.select(F.col(text).alias("text")).filter(share_of(F.col("text"), max(texts, total // one_in), total)).distinct()
    counts = sample.select(F.explode(of("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    with passing_cuts(docs.sparkSession):
        # written: what was shuffled for a frame that the driver has asked for rows stays on disk longer
        found = cut(counts).orderBy(F.desc("n"), "token").limit(most).toPandas().sort_values("token")
    return found["token"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64)


def least_shared(n: int, similarity: float) -> int:
    """How many of its ``n`` shingles a set has in common with any set of this Jaccard similarity, at least."""
    return math.ceil(similarity * n - 1e-9)


def prefix_of(shingles: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets of this similarity have at least one of them in common."""
    n, (known, counts) = len(shingles), frequent
    if not n:
        return shingles
    rank = np.zeros(n, dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - least_shared(n, similarity) + 1]]


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, doc_id: str, text: str, words: int) -> DataFrame:
    """The pairs whose texts have at least this Jaccard similarity of shingle sets; only texts in pairs are read again."""

    @F.pandas_udf("fp long, shingles array<long>")
    def both(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"fp": [set_hash(s) for s in sets], "shingles": sets}, columns=["fp", "shingles"])

    with passing_cuts(docs.sparkSession):
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(nodes, "fp").select("first_doc").distinct()
        # the ids are written, so the planner knows whether they are few enough to leave the texts where they are
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(cut(ends), F.col("doc_id").eqNullSafe(F.col("first_doc")), "left_semi")
        # an id that repeats with another text gives a set that no pair asks for
        sets = cut(rows.select(both("text").alias("e")).select("e.fp", "e.shingles"))
        joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return cut(joined.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct(), stays=True)


def _wanted(similarity: float) -> Column:
    """How many shingles sets of ``na`` and ``nb`` shingles have in common at least, at this similarity."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9)


def _likely(met: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of pairs (``a, b, na, nb``) whose prefixes have enough shingles in common (``shared``) to be similar.

    Beyond the prefixes a set has one shingle less in common than :func:`least_shared` at most.
    """
    least = lambda n: F.ceil(F.lit(similarity) * F.col(n) - 1e-9)
    size = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9
    return met.filter(size & (F.col("shared") + F.greatest(least("na"), least("nb")) - 1 >= _wanted(similarity))).select("a", "b")


def _met_first(placed: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of all pairs in different components (``fp, n, pos, token, root``) that may be similar by what they meet in first.

    All prefixes have one order.  After the first shingle that two similar sets have in common there must be room for all
    others, so it lies early in both: a passage that many otherwise different texts hold comes after what is their own, and
    they do not meet in it.  In the smaller set it lies within ``n - 2 s / (1 + s) n`` shingles.

    Whatever the prefixes of two such sets have in common is among their rows of ``placed``, as sets of two components
    have it; so a pair carries these few shingles and not the prefixes.
    """
    early = F.col("n") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("n") - 1e-9)
    x = placed.select("token", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("pos").alias("pa"))
    y = placed.filter(F.col("pos") <= early).select("token", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("pos").alias("pb"))
    smaller = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _wanted(similarity)
    pairs = x.join(y, "token").filter("ra <> rb").filter(smaller & room).select("a", "b", "na", "nb").distinct()
    held = placed.groupBy("fp").agg(F.collect_set("token").alias("held"))
    both = pairs.join(held.select(F.col("fp").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("fp").alias("b"), F.col("held").alias("y")), "b")
    return _likely(both.withColumn("shared", F.size(F.array_intersect("x", "y"))), similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def ball_links(nodes: DataFrame, docs: DataFrame, similarity: float, doc_id: str, text: str, words: int) -> DataFrame:
    """``a, b``: verified links of ``nodes`` (``fp, first_doc, sim``) whose SimHash ``sim`` is the same or meets in a ball of radius 1."""
    first = cut(nodes.groupBy("sim").agg(F.min("fp").alias("one")))
    same = nodes.join(first, "sim").filter("fp <> one").select(F.col("one").alias("a"), F.col("fp").alias("b"))
    end = lambda c: first.select(F.col("sim").alias(f"{c}_sim"), F.col("one").alias(c))
    near = fingerprint_links(first.select(F.col("sim").alias("fp"))).withColumnsRenamed({"a": "a_sim", "b": "b_sim"})
    return verified(cut(same.union(near.join(end("a"), "a_sim").join(end("b"), "b_sim").select("a", "b"))), docs, nodes, similarity, doc_id, text, words)


def similar_links(nodes: DataFrame, docs: DataFrame, similarity: float, doc_id: str, text: str, words: int, links: DataFrame, rounds: int = 2) -> DataFrame:
    """``a, b``: ``links`` and further verified ones that connect all of ``nodes`` (``fp, first_doc, n, prefix``) that similar pairs connect.

    Sets of this similarity meet in a shingle of their prefixes.  In ``rounds`` every crowd at a shingle is compared with
    its most typical set that is not yet in their component, which makes one component of a family without looking at
    its pairs.  Then all that meet early enough in a shingle and are not in one component are compared: a pair that is left
    out is connected already, or has too few shingles in common to be similar.
    """
    postings = nodes.select("fp", "n", F.posexplode("prefix").alias("pos", "token"))
    crowds = cut(postings.groupBy("token").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"))
    postings = cut(postings.join(crowds, "token"))
    # a set whose shingles many others have is typical
    weights = cut(postings.groupBy("fp").agg((F.sum("crowd") / F.any_value("n")).alias("weight")))
    for k in range(rounds + 1):
        with passing_cuts(docs.sparkSession):
            placed = postings.drop("crowd").join(components(links).withColumnRenamed("node", "fp"), "fp", "left")
            placed = placed.withColumn("root", F.coalesce("root", "fp"))
            open_ = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
            placed = cut(placed.join(open_, "token"))
            if placed.isEmpty():
                break
            if k < rounds:
                # the typical set of the crowd at first, that of the largest rest of a family later
                typical = placed.join(weights, "fp").groupBy("token").agg(F.max(F.struct("weight", "fp", "n", "root")).alias("t"))
                met = placed.join(typical, "token").filter("root <> t.root").select(F.least("fp", "t.fp").alias("a"), F.greatest("fp", "t.fp").alias("b"), F.when(F.col("fp") < F.col("t.fp"), F.col("n")).otherwise(F.col("t.n")).alias("na"), F.when(F.col("fp") < F.col("t.fp"), F.col("t.n")).otherwise(F.col("n")).alias("nb"))
                likely = _likely(met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")), similarity)
            else:
                likely = _met_first(placed, similarity)
            new = verified(cut(likely), docs, nodes, similarity, doc_id, text, words)
            links = cut(links.union(new), stays=True)
    return links


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, fp, component_id`` like :func:`simhash_groups`, for texts of at least ``similarity``.

    Texts link when the Jaccard similarity of their sets of shingles of ``words`` words is at least ``similarity``.  No
    pair below it links and no group that pairs at or above it connect is missed.

    The balls of SimHashes of the sets, which reach 2 bits, find most near copies and make components of families.  Sets
    just above 0.8 differ in about 9 bits, so what balls cannot reach is found by the shingles of prefixes.
    """
    frequent = frequent_shingles(docs, text, words)

    names = ["fp", "n", "sim", "prefix"]

    @F.pandas_udf("fp long, n int, sim long, prefix array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = (shingle_set(t, words) for t in texts)
        return pd.DataFrame([(set_hash(s), len(s), majority_bits(s) if len(s) else 0, prefix_of(s, similarity, frequent)) for s in sets], columns=names)

    with passing_cuts(docs.sparkSession):
        with passing_cuts(docs.sparkSession):
            read = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), of(F.col(text)).alias("e")).select("doc_id", *[f"e.{n}" for n in names]))
            nodes = cut(read.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), *[F.any_value(n).alias(n) for n in names[1:]]), stays=True)
            # prefixes are written once for each set, not for each document
            rows = cut(read.select("doc_id", "fp"), stays=True)
        links = similar_links(nodes, docs, similarity, doc_id, text, words, ball_links(nodes, docs, similarity, doc_id, text, words))
        return cut(_grouped(rows, nodes.select("fp", "first_doc"), links), stays=True)


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of its group of similar texts, with all their columns.

    Rows with a null ``doc_id`` stay if all of their group are null.
    """
    mark, = fresh(docs, "_gone_doc")
    with passing_cuts(docs.sparkSession):
        groups = similar_groups(docs, doc_id, text, words, similarity)
        # an id that repeats with another text stays while one of its rows does
        stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
        # far fewer than the documents; written, so that the planner knows how many
        gone = cut(groups.groupBy(F.col("doc_id").alias(mark)).agg(stays.alias("stays")).filter("not stays").select(mark), stays=True)
    return docs.join(gone, docs[doc_id].eqNullSafe(F.col(mark)), "left_anti")
