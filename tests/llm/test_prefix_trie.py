"""The conversation trie against a trie of Python dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hyperlake.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in own.items()}
    members = {}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    out = []
    for path, ms in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in inside)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        ends = ",".join(map(str, sorted(c for c in ms if paths[c] == path)))
        kids = sum(len(q) == len(path) + 1 and q[: len(path)] == path for q in members)
        out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed=1, n=60):
    r = random.Random(seed)
    out = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, ""])) for c in range(-6, n) for t in range(r.randrange(1, 12))]
    # a hot first turn, ties, repeated rows, a null turn, no conversation, a long conversation, a long text
    out += [(1000 + c, 0, "user", "hi") for c in range(40)] + [(1000 + c, 1, "assistant", str(c)) for c in range(40)]
    out += [(2000, 3, "user", "x"), (2000, 3, "user", "x"), (2000, 3, "assistant", "y"), (2000, None, "user", "z"), (None, 0, "user", "nobody")]
    return out + [(3000, t, "user", str(t % 3)) for t in range(120)] + [(3005, 0, "user", "long é " * 40_000)]


def as_tuples(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def clashing(df):
    for n in ("n", "pos", "k1", "id", "head", "base", "bytes"):
        df = df.selectExpr("*", f"'x' as `{n}`")
    return df


def test_trie_by_rounds_of_ranking(spark):
    given = rows()
    df = clashing(spark.createDataFrame(given, KIND).repartition(5))
    assert as_tuples(prefix_trie.conversation_trie(df, short=8, block=16)) == brute(given)


def test_trie_with_hot_conversations_and_nodes_split(tiny_chunks):
    given = rows(2, 10)
    assert as_tuples(prefix_trie.conversation_trie(tiny_chunks.createDataFrame(given, KIND), short=64)) == brute(given)


@pytest.mark.parametrize("given", [[], [(7, 0, "user", "alone")], [(4, 0, "user", "a")]])
def test_small_tables(spark, given):
    assert as_tuples(prefix_trie.conversation_trie(spark.createDataFrame(given, KIND))) == brute(given)


def test_list_ranking_of_one_long_list(spark):
    n = 3000
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = [(a, order[k - 1] if k else None, order[k + 1] if k + 1 < n else None) for k, a in enumerate(order)]
    got = prefix_trie.list_rank(spark.createDataFrame(links, "arc long, prev long, next long"), short=16).collect()
    assert {r["arc"]: r["position"] for r in got} == {a: k for k, a in enumerate(order)}


def test_prefix_sums_over_blocks(spark):
    got = prefix_trie.prefix_sums(spark.range(100).select(F.col("id").alias("p"), (F.col("id") % 7).alias("v")), "p", ["v"], block=8).collect()
    total = 0
    for r in sorted(got, key=lambda r: r["p"]):
        total += r["v"]
        assert r["sum_v"] == total
