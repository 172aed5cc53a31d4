"""The audit of the vector search on skewed tables."""

import numpy as np
import pandas as pd

from hyperlake.llm import vector_graph


def test_hot_group_does_not_hide_lost_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    hot = [base + 0.01 * rng.normal(size=32) for _ in range(300)]
    pairs = [v for x in rng.normal(size=(150, 32)) for v in (x, x + 0.01 * rng.normal(size=32))]
    vectors = hot + pairs
    nodes = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(vectors)], "node long, copies long, vector array<double>")
    options = vector_graph.GraphOptions(audit=600)
    true = vector_graph.truth(nodes, len(vectors), 0.95, options).sort_values("node")
    assert true["there"].tolist() == [299] * 300 + [1] * 300
    links = lambda n: spark.createDataFrame([(k, 299 if k < 300 else 1, 299 if k < 300 else 1, 0) for k in range(n)], "node long, links long, pairs long, root long")
    assert vector_graph.audited(true, links(600), options) == 1
    # all links of ordinary vectors are lost: 300 of 90,000, as pooled
    assert vector_graph.audited(true, links(300), options) == 0


def test_sample_grows_until_enough_nodes_have_links(spark):
    rng = np.random.default_rng(6)
    vectors = [v for x in rng.normal(size=(40, 32)) for v in (x, x + 0.01 * rng.normal(size=32))] + list(rng.normal(size=(1200, 32)))
    nodes = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(vectors)], "node long, copies long, vector array<double>")
    true = vector_graph.truth(nodes, len(vectors), 0.95, vector_graph.GraphOptions(audit=64, linked=60))
    assert (true["there"] > 0).sum() >= 60
