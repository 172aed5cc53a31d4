"""Quality classifier: random-indexing word vectors and a two-layer network.

Each word gives up to two tokens, its letters in lower case and its shape (``Xx``,
``X!``, ``x$``), both as hash buckets; a word that repeats the one before gives a
third.  A token has a fixed sparse ternary *index vector* picked by its bucket.  Its *context vector*, learned
from a bounded sample, is the average of the index vectors of the tokens around it
plus its own.  A document is pooled to the mean and the root mean square of its word
vectors and classified by a network of two layers, in numpy.  A part of the sample
that is not trained on calibrates the temperature; a shift of the logit undoes the even
mix of labels in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out
from .words import blocks, fit_temperature, sample_per_label, word_hashes

@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    shift: float


def tokens(text: str | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Letter buckets, shape buckets (the upper half of all buckets) and whether a word repeats the one before, block by block."""
    before = None
    for block in blocks((text or "").encode("utf-8", "replace")):
        own, shape, whole = word_hashes(block, bits - 1)
        if not len(own):
            continue
        again = np.concatenate([[before is not None and whole[0] == before], whole[1:] == whole[:-1]])
        before = whole[-1]
        yield own, shape + (1 << (bits - 1)), again


def index_vectors(buckets: int, dim: int, seed: int, nonzero: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dim), dtype=np.float32)
    for _ in range(nonzero):
        out[np.arange(buckets), rng.integers(dim, size=buckets)] += rng.choice([-1.0, 1.0], size=buckets)
    return out / nonzero**0.5


def context_vectors(texts: list[str], bits: int, dim: int, seed: int, window: int = 2) -> np.ndarray:
    """Unit vectors of all token buckets; a bucket that the texts lack keeps its index vector."""
    index = index_vectors(1 << bits, dim, seed)
    total, seen = np.zeros((1 << bits, dim), dtype=np.float64), np.zeros(1 << bits)
    for text in texts:
        for own, shape, _ in tokens(text, bits):
            word = index[shape] + index[own]
            near = np.zeros_like(word)
            for k in range(1, window + 1):
                near[k:] += word[:-k]
                near[:-k] += word[k:]
            for at in (shape, own):
                np.add.at(total, at, near)
                np.add.at(seen, at, 2.0 * window)
    context = total / np.maximum(seen, 1)[:, None]
    length = np.linalg.norm(context, axis=1, keepdims=True)
    mixed = index + np.divide(context, length, out=np.zeros_like(context), where=length > 0)
    return (mixed / np.maximum(np.linalg.norm(mixed, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and root mean square of the word vectors, the share of repeated words and the logarithm of the length."""
    dim, bits = vectors.shape[1], len(vectors).bit_length() - 1
    out, words, repeats = np.zeros(2 * dim + 2), 0, 0
    for own, shape, again in tokens(text, bits):
        x = vectors[own] + vectors[shape]
        out[:dim] += x.sum(axis=0)
        out[dim : 2 * dim] += np.einsum("ij,ij->j", x, x)
        words += len(own)
        repeats += int(again.sum())
    if words:
        # the repeat token has the last bucket
        out[:dim] += repeats * vectors[-1]
        out[: 2 * dim] /= words
        out[dim : 2 * dim] = np.sqrt(out[dim : 2 * dim])
        out[-2:] = repeats / words, np.log1p(words) / 10
    return out


def train(
    texts: list[str], labels: list[int], prior: tuple[float, float], bits: int = 15, dim: int = 32, hidden: int = 24, epochs: int = 150, seed: int = 11,
) -> QualityModel | None:
    """Fit on all but every fifth text, which calibrate.  ``prior``: how many of all labelled documents are 0 and 1."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    vectors = context_vectors(texts, bits, dim, seed)
    x, y = np.stack([pooled(t, vectors) for t in texts]), np.array(labels, dtype=np.float64)
    test = np.arange(len(y)) % 5 == 4
    if not test.any():
        test[:] = True
    fit = ~test if (~test).any() else test
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    p = {"w1": rng.standard_normal((x.shape[1], hidden)) / x.shape[1] ** 0.5, "b1": np.zeros(hidden), "w2": rng.standard_normal(hidden) / hidden**0.5, "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    rows = np.flatnonzero(fit)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            h = np.tanh(x[some] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40))) - y[some]) / len(some)
            dh = d[:, None] * p["w2"] * (1 - h * h)
            g = {"w1": x[some].T @ dh + 1e-3 * p["w1"], "b1": dh.sum(axis=0), "w2": h.T @ d + 1e-3 * p["w2"], "b2": d.sum(keepdims=True)}
            step += 1
            for n in p:  # Adam
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - 3e-3 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(x[test] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    temperature = fit_temperature(np.stack([np.zeros_like(logit), logit], axis=1), y[test].astype(int))
    ones = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    share = min(max(prior[1] / max(sum(prior), 1), 1e-3), 1 - 1e-3)
    shift = float(np.log(share / (1 - share)) - np.log(ones / (1 - ones)))
    return QualityModel(vectors, mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), temperature, shift)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 1500, **options) -> QualityModel | None:
    """Train on at most ``per_label`` documents of each label, none of them held out.

    Labels other than 0 and 1 are left out; of several labels of one document the largest counts.  Two bounded samples
    come to the driver; the shares of the labels are counted over all of them.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_doc")).agg(F.max(label).cast("int").alias("label")).filter(~held_out(F.col("_doc")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = cut(sample_per_label(known, "label", per_label, "_doc"))
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(picked), "_doc").select("_doc", "label", F.coalesce("text", F.lit("")).alias("text"))
    sample = sorted(rows.collect())
    # labels alternate, so that each fifth row calibrates on both
    sample.sort(key=lambda r: crc32(str(r["_doc"]).encode()))
    return train([r["text"] for r in sample], [r["label"] for r in sample], (counts.get(0, 0), counts.get(1, 0)), **options)


def scorer(model: QualityModel | None):
    """A pandas UDF from texts to the probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            x = np.stack([pooled(t, model.vectors) for t in texts]) if len(texts) else np.zeros((0, len(model.mean)))
            h = np.tanh(np.clip((x - model.mean) / model.scale, -8, 8) @ model.w1 + model.b1)
            z = (h @ model.w2 + model.b2) / model.temperature + model.shift
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return score


def rate(docs: DataFrame, model: QualityModel | None, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of good quality.

    A null text counts as empty; empty texts are scored like any other.  Without a model (nothing labelled) every score
    is 0.5.  A column of ``docs`` called like ``score`` is replaced; all others pass through.
    """
    return docs.withColumn(score, scorer(model)(F.col(text)))
