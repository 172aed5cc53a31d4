"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors are collapsed to one node with a count.
2. k-means on a bounded sample gives centroids; every node joins the shards of its
   ``overlap`` nearest ones.  A cluster above ``rows_per_shard`` is dealt into blocks and
   every pair of blocks is a shard, so no task holds more than two blocks.
3. Each shard builds a graph: nearest candidates and random far ones, thinned by the
   robust prune rule (an edge goes when a kept neighbour is ``alpha`` times closer to its
   end), with reverse edges, and with every node reachable from the medoid.
4. The adjacency lists of a node are united over all its shards.
5. Each shard searches for its own members over the united lists: greedily from the
   medoid with a beam, then by range expansion through everything within a slack of the
   threshold.  Pairs found are verified in double precision.  Shards hand on only counts
   and a spanning forest, never pairs; a pair in several shards counts in the first.
6. A bounded set of nodes is compared with all vectors by brute force; it grows until
   enough of them have links.  Every node with links counts the same, whatever its copies
   and its links, and ordinary nodes and hot ones are judged apart.  While one of the two
   falls short of ``recall``, all is done again with more overlap and a wider beam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, share_of


@dataclass(frozen=True)
class GraphOptions:
    """``sample``, ``clusters`` and ``audit_most`` bound what comes to the driver; ``rows_per_shard`` bounds a task.

    The audit takes ``audit`` nodes, and more while fewer than ``linked`` of them have 1 to ``hot`` linked nodes.
    """

    overlap: int = 3
    rows_per_cluster: int = 1000
    rows_per_shard: int = 4000
    clusters: int = 16_384
    sample: int = 20_000
    candidates: int = 48
    far: int = 16
    degree: int = 24
    alpha: float = 1.2
    beam: int = 8
    slack: float = 0.06
    audit: int = 512
    audit_most: int = 8192
    linked: int = 128
    hot: int = 64
    recall: float = 0.995


# --- clustering --------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty cluster takes a random row."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        empty = np.linalg.norm(total, axis=1) < 1e-9
        total[empty] = x[rng.integers(len(x), size=int(empty.sum()))]
        centre = unit(total)
    return centre


def centroids(nodes: DataFrame, rows: int, options: GraphOptions) -> dict[int, np.ndarray]:
    """Centroids by dimension; a dimension that the sample lacks has a single cluster."""
    sample = nodes.filter(share_of(F.col("node"), options.sample, rows)).select("vector").toPandas()["vector"]
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim, vs in by_dim.items():
        share = rows * len(vs) / max(len(sample), 1)
        k = int(min(options.clusters, max(1, round(share / options.rows_per_cluster)), max(1, len(vs) // 4)))
        out[dim] = kmeans(unit(np.stack(vs).astype(np.float64)), k).astype(np.float32)
    return out


def members(nodes: DataFrame, centres: dict[int, np.ndarray], options: GraphOptions) -> DataFrame:
    """``shard, cluster, block, other, node, copies, vector, home``: every node in each of its shards.

    ``home`` lists the node's clusters, so a shard can tell which shard counts a pair.
    """
    overlap = options.overlap

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        out: list[list[int]] = [[0]] * len(vectors)
        for dim in {len(v) for v in vectors}:
            at = [k for k, v in enumerate(vectors) if len(v) == dim]
            centre = centres.get(dim)
            if centre is None or len(centre) == 1:
                continue
            score = np.stack([vectors.iloc[k] for k in at]).astype(np.float32) @ centre.T
            t = min(overlap, len(centre))
            top = np.argpartition(-score, t - 1, axis=1)[:, :t]
            for k, row in zip(at, np.sort(top, axis=1).tolist(), strict=True):
                out[k] = row
        return pd.Series(out)

    homes = cut(nodes.withColumn("home", nearest("vector")).withColumn("dim", F.size("vector")))
    placed = homes.select("*", F.explode("home").alias("cluster"))
    sizes = cut(placed.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / options.rows_per_shard).cast("int")))
    placed = placed.join(sizes.drop("n"), ["dim", "cluster"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shard = F.struct("dim", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return placed.select(shard.alias("shard"), "cluster", "block", "node", "copies", "vector", "home")


# --- one shard: building -----------------------------------------------------


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def robust_prune(x: np.ndarray, options: GraphOptions, seed: int = 2) -> list[np.ndarray]:
    """Out-neighbours of every row of unit vectors ``x``."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(options.candidates, n - 1)
    chosen: list[np.ndarray] = []
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    for low in range(0, n, 256):
        me = np.arange(low, min(low + 256, n))
        sims = x[me] @ x.T
        sims[np.arange(len(me)), me] = -2
        pool = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        pool = np.concatenate([pool, rng.integers(n, size=(len(me), options.far))], axis=1)
        score = np.take_along_axis(sims, pool, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        pool, score = np.take_along_axis(pool, order, axis=1), np.take_along_axis(score, order, axis=1)
        vectors = x[pool]
        between = 1 - vectors @ vectors.transpose(0, 2, 1)
        alive = score > -2
        alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
        kept = np.zeros_like(alive)
        for k in range(pool.shape[1]):
            take = alive[:, k] & (kept.sum(axis=1) < options.degree)
            kept[:, k] = take
            covered = options.alpha * between[:, k, :] <= 1 - score
            alive &= ~(covered & take[:, None])
            alive[:, k] = False
        chosen += [p[m] for p, m in zip(pool, kept, strict=True)]
    return chosen


def build(x: np.ndarray, options: GraphOptions) -> list[np.ndarray]:
    """The shard's graph: pruned edges, their reverses, and edges that make all reachable from the medoid."""
    n, out = len(x), robust_prune(x, options)
    ends = np.concatenate(out) if n else np.zeros(0, dtype=np.int64)
    starts = np.repeat(np.arange(n), [len(o) for o in out])
    pairs = np.unique(np.concatenate([starts * n + ends, ends * n + starts])) if n else np.zeros(0, dtype=np.int64)
    a, b = pairs // max(n, 1), pairs % max(n, 1)
    lists = np.split(b, np.searchsorted(a, np.arange(1, n))) if n else []
    reached = np.zeros(n, dtype=bool)
    front = np.array([medoid(x)]) if n else np.zeros(0, dtype=np.int64)
    while len(front):
        reached[front] = True
        nxt = np.unique(np.concatenate([lists[k] for k in front])) if len(front) else front
        front = nxt[~reached[nxt]]
        if not len(front) and not reached.all():
            # the closest pair across the gap, of one unreached row
            u = int(np.flatnonzero(~reached)[0])
            r = int(np.where(reached, x @ x[u], -2).argmax())
            lists[r], lists[u] = np.append(lists[r], u), np.append(lists[u], r)
            front = np.array([u])
    return lists


# --- one shard: searching ----------------------------------------------------


def search(x: np.ndarray, lists: list[np.ndarray], threshold: float, options: GraphOptions) -> np.ndarray:
    """Which rows each row finds: greedy from the medoid, then range expansion.  A boolean matrix, made symmetric."""
    n = len(x)
    width = max((len(v) for v in lists), default=0)
    table = np.full((n, max(width, 1)), -1, dtype=np.int64)
    for k, v in enumerate(lists):
        table[k, : len(v)] = v
    seen, found = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)

    def visit(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New (query, row) pairs among the neighbours of ``at``, with their similarity."""
        many = table[at]
        qs, rows = np.repeat(q, many.shape[1]), many.ravel()
        new = rows >= 0
        qs, rows = qs[new], rows[new]
        new = ~seen[qs, rows]
        flat = np.unique(qs[new] * n + rows[new])
        qs, rows = flat // n, flat % n
        seen[qs, rows] = True
        # a slice at a time, as the gathered vectors are many times larger than the pairs
        sims = np.empty(len(qs), dtype=np.float32)
        for k in range(0, len(qs), 1 << 15):
            sims[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[qs[k : k + (1 << 15)]], x[rows[k : k + (1 << 15)]])
        return qs, rows, sims

    loose = threshold - options.slack
    start = medoid(x)
    beam = np.full((n, options.beam), -1, dtype=np.int64)
    score = np.full((n, options.beam), -2.0, dtype=np.float32)
    fresh = np.zeros((n, options.beam), dtype=bool)
    beam[:, 0], score[:, 0], fresh[:, 0] = start, x @ x[start], True
    seen[:, start] = True
    inside_q, inside_r = [np.flatnonzero(score[:, 0] >= loose)], [np.full(int((score[:, 0] >= loose).sum()), start)]
    active = np.arange(n)
    while len(active):
        best = np.where(fresh[active], score[active], -3).argmax(axis=1)
        at = beam[active, best]
        fresh[active, best] = False
        qs, rows, sims = visit(active, at)
        close = sims >= loose
        inside_q.append(qs[close])
        inside_r.append(rows[close])
        # merge what is new into the beams: queries are sorted, so each one's rows are a run
        order = np.lexsort((-sims, qs))
        qs, rows, sims = qs[order], rows[order], sims[order]
        rank = np.arange(len(qs)) - np.searchsorted(qs, qs)
        top = rank < options.beam
        qs, rows, sims, rank = qs[top], rows[top], sims[top], rank[top]
        more_b, more_s = np.full((n, options.beam), -1, dtype=np.int64), np.full((n, options.beam), -2.0, dtype=np.float32)
        more_b[qs, rank], more_s[qs, rank] = rows, sims
        all_b, all_s = np.concatenate([beam[active], more_b[active]], axis=1), np.concatenate([score[active], more_s[active]], axis=1)
        all_f = np.concatenate([fresh[active], more_b[active] >= 0], axis=1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, : options.beam]
        beam[active], score[active], fresh[active] = (np.take_along_axis(v, order, axis=1) for v in (all_b, all_s, all_f))
        active = active[fresh[active].any(axis=1)]
    q, r = np.concatenate(inside_q), np.concatenate(inside_r)
    while len(q):
        found[q, r] = True
        parts = []
        for k in range(0, len(q), 4096):
            qs, rows, sims = visit(q[k : k + 4096], r[k : k + 4096])
            close = sims >= loose
            parts.append((qs[close], rows[close]))
        q, r = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return found | found.T


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row linked to each row, directly or not, by label passing with pointer jumps."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    return root


def judge(pdf: pd.DataFrame, threshold: float, options: GraphOptions) -> pd.DataFrame:
    """``node, links, pairs, root`` of a shard's members: verified copies and nodes that this shard counts, and a node of their component."""
    pdf = pdf.sort_values("node").reset_index(drop=True)
    n, nodes = len(pdf), pdf["node"].to_numpy()
    exact = unit(np.stack(pdf["vector"].to_list()).astype(np.float64))
    x = exact.astype(np.float32)
    at = {v: k for k, v in enumerate(nodes.tolist())}
    lists = [np.array([at[v] for v in (near if near is not None else ()) if v in at], dtype=np.int64) for near in pdf["near"]]
    found = search(x, lists, threshold, options)
    np.fill_diagonal(found, False)
    cluster, low, high = (int(pdf["shard"].iloc[0][k]) for k in ("cluster", "low", "high"))
    width = max(len(h) for h in pdf["home"])
    home = np.full((n, width), -1, dtype=np.int64)
    for k, h in enumerate(pdf["home"]):
        home[k, : len(h)] = h
    # clusters before this one: a pair that shares one of them counts there
    earlier = np.where((home >= 0) & (home < cluster), home, -1)
    block, copies = pdf["block"].to_numpy(), pdf["copies"].to_numpy()
    links, pairs = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    edges = []
    qs, rs = np.nonzero(np.triu(found))
    for k in range(0, len(qs), 1 << 15):
        q, r = qs[k : k + (1 << 15)], rs[k : k + (1 << 15)]
        true = np.einsum("ij,ij->i", exact[q], exact[r]) >= threshold
        q, r = q[true], r[true]
        edges.append((q, r))
        other = ((earlier[q][:, :, None] == earlier[r][:, None, :]) & (earlier[q] >= 0)[:, :, None]).any(axis=(1, 2))
        mine = ~other & (np.minimum(block[q], block[r]) == low) & (np.maximum(block[q], block[r]) == high)
        np.add.at(links, q[mine], copies[r[mine]])
        np.add.at(links, r[mine], copies[q[mine]])
        np.add.at(pairs, q[mine], 1)
        np.add.at(pairs, r[mine], 1)
    a = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, dtype=np.int64)
    b = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, dtype=np.int64)
    root = spanning(n, a, b)
    told = (links > 0) | (root != np.arange(n))
    return pd.DataFrame({"node": nodes[told], "links": links[told], "pairs": pairs[told], "root": nodes[root[told]]})


# --- all shards --------------------------------------------------------------


def link_counts(nodes: DataFrame, centres: dict[int, np.ndarray], threshold: float, options: GraphOptions) -> DataFrame:
    """``node, links, pairs, root`` of every shard, for nodes with links."""
    shards = cut(members(nodes, centres, options))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        lists = build(unit(np.stack(pdf["vector"].to_list()).astype(np.float64)).astype(np.float32), options)
        return pd.DataFrame({"node": ids, "near": [ids[v] for v in lists]})

    edges = shards.select("shard", "node", "vector").groupBy("shard").applyInPandas(graph, "node long, near array<long>")
    united = edges.select("node", F.explode("near").alias("v")).groupBy("node").agg(F.collect_set("v").alias("near"))
    told = shards.join(united, "node", "left").groupBy("shard").applyInPandas(lambda pdf: judge(pdf, threshold, options), "node long, links long, pairs long, root long")
    return cut(told)


def true_pairs(nodes: DataFrame, chosen: pd.DataFrame, threshold: float) -> np.ndarray:
    """How many other nodes each chosen node (``node, vector``) links with, by brute force."""
    size = len(chosen)
    by_dim = {d: [k for k, v in enumerate(chosen["vector"]) if len(v) == d] for d in {len(v) for v in chosen["vector"]}}
    queries = {d: (np.array(at), unit(np.stack([chosen["vector"].iloc[k] for k in at]).astype(np.float64))) for d, at in by_dim.items()}
    # a pair at the threshold itself may be summed in another order than in its shard
    bound = threshold + 1e-12

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            dims = b["vector"].map(len).to_numpy()
            for d, (at, q) in queries.items():
                if (dims == d).any():
                    x = unit(np.stack(b["vector"][dims == d].to_list()).astype(np.float64))
                    for k in range(0, len(at), 512):
                        total[at[k : k + 512]] += ((q[k : k + 512] @ x.T) >= bound).sum(axis=1)
        yield pd.DataFrame({"k": np.arange(size), "n": total})

    true = nodes.select("vector").mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas().sort_values("k")
    # without the node itself
    return np.maximum(true["n"].to_numpy() - 1, 0)


def worst_recall(there: np.ndarray, got: np.ndarray, hot: int) -> float:
    """The smaller of the mean recalls of nodes with 1 to ``hot`` true links and of those with more."""
    recall = np.minimum(got / np.maximum(there, 1), 1.0)
    classes = [(there > 0) & (there <= hot), there > hot]
    return min((float(recall[c].mean()) for c in classes if c.any()), default=1.0)


def truth(nodes: DataFrame, rows: int, threshold: float, options: GraphOptions) -> pd.DataFrame:
    """``node, there``: the audited nodes and how many nodes each truly links with."""
    wanted = options.audit
    while True:
        chosen = nodes.filter(share_of(F.hash("node"), wanted, rows)).select("node", "vector").toPandas()
        there = true_pairs(nodes, chosen, threshold) if len(chosen) else np.zeros(0, dtype=np.int64)
        ordinary = int(((there > 0) & (there <= options.hot)).sum())
        if ordinary >= options.linked or wanted >= min(rows, options.audit_most):
            return pd.DataFrame({"node": chosen["node"], "there": there})
        wanted = min(wanted * 4, options.audit_most)


def audited(true: pd.DataFrame, links: DataFrame, options: GraphOptions) -> float:
    """The worst mean recall of links over the audited nodes."""
    if not len(true):
        return 1.0
    chosen = links.sparkSession.createDataFrame(true[["node"]])
    got = links.join(F.broadcast(chosen), "node").groupBy("node").agg(F.sum("pairs").alias("got")).toPandas()
    both = true.merge(got, on="node", how="left").fillna({"got": 0})
    return worst_recall(both["there"].to_numpy(), both["got"].to_numpy(dtype=np.float64), options.hot)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, options: GraphOptions = GraphOptions()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: how many others have a cosine of ``threshold`` or more.

    A vector that is null, empty or zero, or has a null or non-finite component, links with nothing, and neither does a
    row with a null ``vec_id`` (its ``component_id`` is null).  Vectors of different length do not link.  Equal vectors
    link with each other.  ``component_id`` is the smallest ``vec_id`` reachable over links and ``kept`` tells whether the
    row has it; rows that repeat a ``vec_id`` count as different vectors.  Other columns are not read.
    """
    v = F.col("vector")
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    sound = sound & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    read = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).withColumn("sound", sound)
    hashed = read.withColumns({"h1": F.when(F.col("sound"), F.xxhash64("vector")), "h2": F.when(F.col("sound"), F.xxhash64(F.lit(1), "vector"))})
    rows = cut(hashed.select("vec_id", "sound", "h1", "h2"))
    groups = hashed.filter("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    whole = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    nodes = whole.select("node", "copies", "vector")
    total = nodes.count()
    true = truth(nodes, total, threshold, options)
    while True:
        links = link_counts(nodes, centroids(nodes, total, options) if total else {}, threshold, options)
        everywhere = options.overlap * options.rows_per_cluster >= 2 * max(total, 1)
        # everything is in one reach: each shard has compared all its members
        if audited(true, links, options) >= options.recall or everywhere and options.slack > 1 + threshold:
            break
        options = GraphOptions(**{**options.__dict__, "overlap": options.overlap * 2, "beam": options.beam * 2, "degree": options.degree + 8, "slack": options.slack * 1.5})
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = whole.select("node", "h1", "h2", "first_id", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut(known)
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.filter("sound").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
