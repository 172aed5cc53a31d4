"""What the near-copy stage leaves on disk, and how its work grows with the table."""

import os

import numpy as np
import pytest

from hyperlake.llm import simhash_ball
from hyperlake.session import cut, passing_cuts, shared_dir

WORDS = np.array([f"w{k}" for k in range(20_000)])


def cuts(spark):
    top = shared_dir(spark).removeprefix("file://")
    return {d for d in os.listdir(top) if d.startswith("cut-")} if os.path.isdir(top) else set()


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_cuts_of_a_block_go_and_those_that_stay_belong_to_the_block_around(spark):
    before = cuts(spark)
    with passing_cuts(spark):
        with passing_cuts(spark):
            gone, kept = cut(spark.range(3)), cut(spark.range(4), stays=True)
            assert gone.count() == 3
        assert len(cuts(spark) - before) == 1 and kept.count() == 4
    assert cuts(spark) == before
    with passing_cuts(spark):
        last = cut(spark.range(5), stays=True)
    outside = cut(spark.range(6))
    assert len(cuts(spark) - before) == 2 and (last.count(), outside.count()) == (5, 6)


def test_a_block_that_raises_leaves_its_cuts(spark):
    before = cuts(spark)
    with pytest.raises(ValueError), passing_cuts(spark):
        left = cut(spark.range(3))
        raise ValueError
    assert len(cuts(spark) - before) == 1 and left.count() == 3
    later = cut(spark.range(2))
    assert len(cuts(spark) - before) == 2 and later.count() == 2


def test_the_stage_leaves_only_what_its_result_reads(spark):
    rng = np.random.default_rng(7)
    base = [rng.choice(WORDS, size=100) for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, "end"]) for b in base[:30]] + [" ".join(b) for b in base[:10]]
    before = cuts(spark)
    out = simhash_ball.drop_near(table(spark, texts))
    assert len(cuts(spark) - before) == 1
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(60))
    # groups are read after their cuts went, too
    groups = simhash_ball.similar_groups(table(spark, texts))
    assert sorted((r["doc_id"], r["component_id"]) for r in groups.collect())[60:63] == [(60, 0), (61, 1), (62, 2)]


def test_an_empty_table_leaves_no_more(spark):
    before = cuts(spark)
    assert simhash_ball.drop_near(table(spark, ["x"]).limit(0)).count() == 0
    assert len(cuts(spark) - before) == 1


def test_the_sample_that_orders_shingles_grows_with_the_table(spark):
    rng = np.random.default_rng(8)
    passage = rng.choice(WORDS, size=30)
    # a passage in a tenth of the texts; ten texts hold it once, an eighth of the table twenty times
    texts = [" ".join([*(passage if k % 10 == 0 else []), *rng.choice(WORDS, size=20)]) for k in range(1600)]
    known, counts = simhash_ball.frequent_shingles(table(spark, texts), "text", 5, texts=10)
    assert set(simhash_ball.shingle_set(" ".join(passage), 5)) <= set(known.tolist())
    assert counts.min() >= 3


def test_candidates_are_the_pairs_whose_prefixes_have_enough_in_common(spark):
    """Against whole prefixes, over sets in known components."""
    rng, similarity = np.random.default_rng(9), 0.8
    sets, root = {}, {}
    for family in range(20):
        base = rng.choice(400, size=40, replace=False)
        for _ in range(5):
            own = np.unique(np.concatenate([base[: rng.integers(30, 41)], rng.choice(400, size=rng.integers(0, 6))]))
            fp = len(sets) + 1
            sets[fp], root[fp] = own.astype(np.int64), family * 5 + 1 if rng.random() < 0.3 else fp
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    prefix = {fp: simhash_ball.prefix_of(s, similarity, none) for fp, s in sets.items()}
    holders = {}
    for fp, p in prefix.items():
        for t in p.tolist():
            holders.setdefault(t, set()).add(root[fp])
    placed = [(fp, len(sets[fp]), pos, t, root[fp]) for fp, p in prefix.items() for pos, t in enumerate(p.tolist()) if len(holders[t]) > 1]
    found = simhash_ball._met_first(spark.createDataFrame(placed, "fp long, n int, pos int, token long, root long"), similarity)
    got = {(r["a"], r["b"]) for r in found.collect()}
    least = lambda n: simhash_ball.least_shared(n, similarity)
    similar = 0
    for b in sets:
        for a in range(1, b):
            na, nb, both = len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))
            wanted = np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-9)
            if (a, b) in got:
                assert root[a] != root[b] and len(np.intersect1d(prefix[a], prefix[b])) + max(least(na), least(nb)) - 1 >= wanted
            elif root[a] != root[b]:
                assert both < similarity * (na + nb - both)
            similar += root[a] != root[b] and both >= similarity * (na + nb - both)
    assert similar >= 20
