"""A trie of conversation prefixes, summed up by the Euler-tour technique.

Every node gives two arcs, one that enters it from its parent and one that leaves it again.  Linked by "what comes
next" they are one list, the Euler tour of the trie.  The list is ranked without walking it: in each round arcs that no
neighbour outranks (by a hash) leave the list and their neighbours close the gap, so about a third goes; the rounds are
then undone in reverse, each giving positions to what it had removed.  Along the positions, running sums of what nodes
carry are prefix sums over the whole trie, and a subtree is what lies between its two arcs.

Prefixes are named by sums of hashes of (position, role, text), so a prefix is a running sum over its conversation and
a node's parent is known without a join.  The order of children comes from one scan over the children of each node
together with the node itself; hot conversations and nodes with very many children are split in both scans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordered import rlast, rlead, rnumber, rsum, scan
from .common import cut

#: each of the three parts of a turn's hash has 40 bits, so the sums of 8 million turns stay below 2^63
PARTS, BITS = ("k1", "k2", "k3"), 40
#: a list this short is ranked in one task
SHORT = 4096
#: positions summed up by one window of the prefix sums
BLOCK = 1 << 16


def turn_hash(position: Column, role: Column, text: Column) -> list[Column]:
    """120 bits of a turn at its position, as three columns."""
    digest = F.sha2(F.concat(position.cast("string"), F.lit(":"), F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    size = BITS // 4
    return [F.conv(F.substring(digest, 1 + size * i, size), 16, 10).cast("long").alias(f"x{i + 1}") for i in range(len(PARTS))]


# --- nodes -------------------------------------------------------------------


def rebuilt_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(``conv_id``, one row each) and the turns of the rebuilt conversations, as ``conv_id, pos, role, text``."""
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).filter("conv_id is not null")
    numbered = cut(scan(rows, ["conv_id"], ["turn", "role", "text"], {"n": rnumber()}).drop("turn"))
    sizes = numbered.groupBy("conv_id").agg(F.max("n").alias("size"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("head"))
    convs = cut(convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").withColumn("taken", F.least("head", F.coalesce("base_size", F.lit(0)))))
    # a base gives fewer than `most` turns to each of the `group` conversations that share it
    lent = convs.select("conv_id", "base", "taken").join(numbered.filter(F.col("n") < most).withColumnRenamed("conv_id", "base"), "base").filter("n <= taken")
    own = numbered.withColumn("head", head).filter("n > head").join(convs.select("conv_id", "taken"), "conv_id")
    turns = lent.select("conv_id", F.col("n").alias("pos"), "role", "text").union(own.select("conv_id", (F.col("n") - F.col("head") + F.col("taken")).alias("pos"), "role", "text"))
    return convs.select("conv_id"), turns


def prefix_nodes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, depth, k1, k2, k3, p1, p2, p3, conv_id, n_convs, bytes`` (k names the prefix, p its parent) and each conversation's last node."""
    hashed = turns.select("conv_id", "pos", *turn_hash(F.col("pos"), F.col("role"), F.col("text")), F.octet_length("text").alias("bytes"))
    sums = {k: rsum(f"x{i + 1}") for i, k in enumerate(PARTS)}
    named = cut(scan(cut(hashed), ["conv_id"], ["pos"], sums))
    before = [(F.col(k) - F.col(f"x{i + 1}")).alias(f"p{i + 1}") for i, k in enumerate(PARTS)]
    keyed = named.select("conv_id", F.col("pos").alias("depth"), *PARTS, *before, "bytes")
    parents = [f"p{i + 1}" for i in range(len(PARTS))]
    nodes = keyed.groupBy("depth", *PARTS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").cast("long").alias("bytes"), *[F.min(p).alias(p) for p in parents])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), *[zero.alias(k) for k in PARTS], "conv_id", "n_convs", zero.alias("bytes"), *[none.alias(p) for p in parents])
    last = named.groupBy("conv_id").agg(F.max(F.struct(F.col("pos").alias("depth"), *PARTS)).alias("l"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"l.{c}", zero).alias(c) for c in ("depth", *PARTS)])
    return cut(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id())), ends


def kinship(nodes: DataFrame) -> DataFrame:
    """``id, parent, parent_conv_id, first_child, next_sibling``: children in the order of their ``conv_id``."""
    none = F.lit(None).cast("long")
    parents = [f"p{i + 1}" for i in range(len(PARTS))]
    selves = nodes.select("depth", *PARTS, none.alias("at"), "id", F.col("conv_id").alias("own_conv"), F.col("id").alias("own_id"))
    children = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(parents, PARTS, strict=True)], F.col("conv_id").alias("at"), "id", none.alias("own_conv"), none.alias("own_id"))
    # a node comes before its children, so what follows it is its first child, and the last `own` of a child is its parent
    lines = scan(cut(selves.union(children)), ["depth", *PARTS], ["at", "id"], {"after": rlead("id"), "parent": rlast("own_id"), "parent_conv_id": rlast("own_conv")})
    child = F.col("own_id").isNull()
    per = lines.groupBy("id").agg(
        F.max(F.when(child, F.col("parent"))).alias("parent"), F.max(F.when(child, F.col("parent_conv_id"))).alias("parent_conv_id"),
        F.max(F.when(~child, F.col("after"))).alias("first_child"), F.max(F.when(child, F.col("after"))).alias("next_sibling"),
    )
    return per


# --- the tour ----------------------------------------------------------------


def tour(kin: DataFrame) -> DataFrame:
    """``arc, prev, next``: enter arcs are ``2 id``, exit arcs ``2 id + 1``; null at both ends of the list."""
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    after_enter = F.coalesce(enter("first_child"), leave("id"))
    after_leave = F.coalesce(enter("next_sibling"), leave("parent"))
    links = kin.select(F.explode(F.array(F.struct(enter("id").alias("arc"), after_enter.alias("next")), F.struct(leave("id").alias("arc"), after_leave.alias("next")))).alias("l")).select("l.arc", "l.next")
    links = cut(links)
    both = links.select("arc", "next", F.lit(None).cast("long").alias("prev")).union(links.filter("next is not null").select(F.col("next"), F.lit(None).cast("long"), F.col("arc")))
    return both.groupBy("arc").agg(F.max("prev").alias("prev"), F.max("next").alias("next"))


def _rank_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    after = {p: (a, gap) for b in batches for a, p, gap in b[["arc", "prev", "gap"]].itertuples(index=False)}
    out, arc, place = [], -1, 0
    while arc in after:
        arc, gap = after[arc]
        place += gap
        out.append((arc, place))
    yield pd.DataFrame(out, columns=["arc", "position"])


def list_rank(arcs: DataFrame, short: int = SHORT) -> DataFrame:
    """``arc, position`` from 0 for one doubly linked list ``arc, prev, next``.

    An arc leaves a round when its hash is above those of both neighbours, so no two neighbours leave together; its
    neighbours learn of each other in one aggregation.  ``gap`` is how far an arc lies behind its ``prev``.
    """
    now = cut(arcs.withColumn("gap", F.when(F.col("prev").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")))
    left, size = [], now.count()
    while size > short:
        mix = lambda c, r=len(left): F.xxhash64(F.lit(r), F.col(c))
        goes = F.col("prev").isNotNull() & F.col("next").isNotNull() & (mix("arc") > mix("prev")) & (mix("arc") > mix("next"))
        marked = now.withColumn("goes", F.coalesce(goes, F.lit(False)))
        left.append(marked.filter("goes").select("arc", "prev", "gap"))
        # what stays tells of itself; what goes tells both neighbours of each other
        none = F.lit(None).cast("long")
        stays = F.array(F.struct("arc", "prev", "next", "gap", none.alias("new_prev"), none.alias("new_next")))
        tells = F.array(
            F.struct(F.col("prev").alias("arc"), none.alias("prev"), none.alias("next"), F.lit(0).cast("long").alias("gap"), none.alias("new_prev"), F.col("next").alias("new_next")),
            F.struct(F.col("next").alias("arc"), none.alias("prev"), none.alias("next"), F.col("gap"), F.col("prev").alias("new_prev"), none.alias("new_next")),
        )
        said = marked.select(F.explode(F.when(F.col("goes"), tells).otherwise(stays)).alias("m")).select("m.*")
        per = said.groupBy("arc").agg(
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"), F.coalesce(F.max("new_next"), F.max("next")).alias("next"), F.sum("gap").alias("gap")
        )
        now = cut(per)
        size = now.count()
    ranked = cut(now.select("arc", F.coalesce("prev", F.lit(-1)).alias("prev"), "gap").coalesce(1).mapInPandas(_rank_short, "arc long, position long"))
    for gone in reversed(left):
        placed = gone.join(ranked.select(F.col("arc").alias("prev"), "position"), "prev").select("arc", (F.col("position") + F.col("gap")).alias("position"))
        ranked = cut(ranked.union(placed))
    return ranked


def prefix_sums(rows: DataFrame, position: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with inclusive running sums ``sum_<value>`` along a dense ``position``: sums inside blocks, plus those of the blocks before."""
    blocked = cut(rows.withColumn("_block", F.floor(F.col(position) / block)))
    totals = blocked.groupBy("_block").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # one row for each block of positions
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_block", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_s_{v}") for v in values])
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({f"_r_{v}": F.sum(v).over(inside) for v in values})
    return local.join(shifts, "_block").select(*rows.columns, *[(F.col(f"_r_{v}") + F.col(f"_s_{v}")).alias(f"sum_{v}") for v in values])


# --- results -----------------------------------------------------------------


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the joined ids of each node; rows come sorted, so a node's ids pass by without being gathered."""
    at, digest = None, None
    for b in batches:
        keys = list(zip(b["depth"], b["k1"], b["k2"], b["k3"], strict=True))
        ids, start, out = b["conv_id"].to_list(), 0, []
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            text = ",".join(map(str, ids[start:end])).encode()
            if keys[start] == at:
                digest.update(b"," + text)
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = keys[start], hashlib.sha256(text)
            start = end
        yield pd.DataFrame(out, columns=["depth", *PARTS, "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["depth", *PARTS, "ends_sha256"])


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 5, most: int = 9, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for every node.

    Conversation ``c`` is rebuilt from the first ``h`` turns of conversation ``c - c % group`` and its own turns after
    its first ``h``, where ``h`` is the CRC-32 of ``c`` in decimal, modulo ``most``.  Each distinct sequence of first
    turns (role and text) is a node, the root has none.  ``conv_id`` is the smallest conversation that starts with it.

    Turns are ordered by ``turn`` (null first), of equal turns by role and text; rows that repeat are turns like any
    others.  A null role or text is empty.  Rows with a null ``conv_id`` belong to no conversation and are left out.
    Other columns are not read.  An empty table gives an empty table.  ``ends_sha256`` is one stream by definition: the
    ids of a node pass through one task, which holds a batch of them at a time.
    """
    convs, turns = rebuilt_turns(conversations, conv_id, turn, role, text, group, most)
    nodes, ends = prefix_nodes(convs, turns)
    kin = cut(kinship(nodes))
    positions = list_rank(tour(kin), short)
    facts = nodes.select("id", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")).join(kin.select("id", F.col("first_child").isNull().cast("long").alias("leaf")), "id")
    # what a node carries stands at its enter arc; an exit arc carries nothing
    on_tour = positions.select(F.shiftright("arc", 1).alias("id"), (F.col("arc") % 2).alias("out"), "position").join(facts, "id")
    carried = on_tour.select("id", "out", "position", *[F.when(F.col("out") == 0, F.col(v)).otherwise(F.lit(0)).alias(v) for v in ("leaf", "saved")])
    summed = prefix_sums(carried, "position", ["leaf", "saved"], block)
    # from before the enter arc to the exit arc
    inside = lambda v: F.sum(F.when(F.col("out") == 1, F.col(f"sum_{v}")).otherwise(F.col(v) - F.col(f"sum_{v}")))
    subtrees = summed.groupBy("id").agg(inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"))
    children = kin.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    key = ["depth", *PARTS]
    digests = ends.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInPandas(_end_digests, "depth long, k1 long, k2 long, k3 long, ends_sha256 string")
    whole = nodes.join(kin.select("id", "parent_conv_id"), "id").join(subtrees, "id").join(children, "id", "left").join(digests, key, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
