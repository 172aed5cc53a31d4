"""Groups of similar texts against components of brute force."""

import numpy as np

from hyperlake.llm import simhash_ball

WORDS = np.array([f"w{k}" for k in range(20_000)])


def shingles(text):
    parts = text.split()
    return {" ".join(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()


def brute(texts):
    """The smallest index of each text's component."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            shared = len(sets[a] & sets[b])
            if root[a] != root[b] and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def groups(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return [c for _, c in sorted((r["doc_id"], r["component_id"]) for r in simhash_ball.similar_groups(rows).collect())]


def changed(rng, base, n):
    out = base.copy()
    out[rng.choice(np.arange(5, len(base) - 5, 5), size=n, replace=False)] = rng.choice(WORDS, size=n)
    return out


def test_family_around_a_base_is_one_group(spark):
    rng = np.random.default_rng(3)
    base = rng.choice(WORDS, size=300)
    texts = [" ".join(base)] + [" ".join(changed(rng, base, 6)) for _ in range(400)] + [" ".join(rng.choice(WORDS, size=300)) for _ in range(50)]
    want = brute(texts)
    assert want[:401] == [0] * 401
    assert groups(spark, texts) == want


def test_pairs_near_the_bound_are_all_found(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(120):
        base = rng.choice(WORDS, size=200)
        # 0.815 and 0.774
        texts += [" ".join(base), " ".join(changed(rng, base, 4)), " ".join(changed(rng, base, 5))]
    want = brute(texts)
    assert sum(r < k for k, r in enumerate(want)) >= 120
    assert groups(spark, texts) == want


def test_filler_does_not_make_texts_alike(spark):
    rng = np.random.default_rng(5)
    # one shingle is more than half of all, and the rest differs
    texts = [" ".join([*rng.choice(WORDS, size=40), *["0"] * 400]) for _ in range(20)]
    texts += texts[:3]
    want = brute(texts)
    assert want == [*range(20), 0, 1, 2]
    assert groups(spark, texts) == want


def test_a_passage_of_a_third_of_the_texts_does_not_pair_them(spark, monkeypatch):
    """Texts that share most of their shingles but are not similar: no pair of them is compared, and those that are similar are found."""
    rng = np.random.default_rng(6)
    passage = rng.choice(WORDS, size=60)
    holders = [" ".join([*passage, *rng.choice(WORDS, size=18)]) for _ in range(150)]
    texts = [*holders, *[" ".join(rng.choice(WORDS, size=70)) for _ in range(300)], *[h + " end" for h in holders[:5]]]
    want = brute(texts)
    assert want[:150] == list(range(150)) and want[-5:] == list(range(5))
    seen = []
    verified = simhash_ball.verified
    monkeypatch.setattr(simhash_ball, "verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))
    assert groups(spark, texts) == want
    assert sum(seen) < 5 * len(texts)
