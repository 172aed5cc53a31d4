"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word is a run of letters in lower case between two marks; its subwords are all its
byte n-grams, each hashed to one of ``2 ** bits`` rows of an embedding table.  A
document is the average of all its subwords' embeddings.  Both the table and the
softmax layer are trained in numpy by stochastic gradient descent on a bounded sample
of labelled documents and on short passages of them.  A part of the sample that is not
trained on calibrates the temperature and the rejection threshold.

Since the layer is linear, the logits of a document are the average of its subwords'
logits; workers get the product of table and layer, one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out
from .words import fit_temperature, sample_per_label, softmax, subword_buckets

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``logits`` has a row for each bucket and a column for each of ``languages``."""

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int
    longest: int


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def _bag(text: str, bits: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and the share of each."""
    ids = np.concatenate([np.zeros(0, dtype=np.int64), *subword_buckets(text, bits, longest)])
    rows, counts = np.unique(ids, return_counts=True)
    return rows, (counts / max(len(ids), 1)).astype(np.float32)


def train(
    texts: list[str], labels: list[str], bits: int = 15, dim: int = 16, longest: int = 4, epochs: int = 6, rate: float = 4.0, seed: int = 7,
    false_rejections: float = 0.001,
) -> LanguageModel | None:
    """Fit on texts with letters; every fifth calibrates instead.  Returns None when there is nothing to learn from."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    bags, ys, fold, short = [], [], [], []
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        if not has_letter(text):
            continue
        words = text.split()
        start, size = int(rng.integers(len(words))), int(rng.integers(3, 20))
        for passage, is_short in ((text, False), (" ".join(words[start : start + size]), True)):
            bag = _bag(passage, bits, longest)
            if not len(bag[0]):
                continue
            bags.append(bag)
            ys.append(languages.index(label))
            fold.append(k % 5 == 4)
            short.append(is_short)
    if not bags:
        return None
    y, fold, short = np.array(ys), np.array(fold), np.array(short)
    table = (rng.standard_normal((1 << bits, dim)) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    trained = np.flatnonzero(~fold) if (~fold).any() else np.arange(len(y))
    share = np.bincount(y[trained], minlength=len(languages)).astype(np.float32)
    weight = share.sum() / np.maximum(share, 1) / max(len(languages), 1)
    batch = 16
    steps = epochs * -(-len(trained) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(trained)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = np.stack([bags[i][1] @ table[bags[i][0]] for i in some])
            g = softmax(hidden @ layer + bias)
            g[np.arange(len(some)), y[some]] -= 1
            g *= (weight[y[some]] / len(some))[:, None]
            back = g @ layer.T
            layer -= lr * hidden.T @ g
            bias -= 0.1 * lr * g.sum(axis=0)
            for i, b in zip(some, back, strict=True):
                rows, share_of = bags[i]
                table[rows] -= lr * share_of[:, None] * b * len(rows) ** 0.5
    logits = table @ layer
    test = np.flatnonzero(fold) if fold.any() else trained
    scored = np.stack([bags[i][1] @ logits[bags[i][0]] for i in test]) + bias
    temperature = fit_temperature(scored, y[test])
    sure = softmax(scored / temperature)
    right = (sure.argmax(axis=1) == y[test]) & ~short[test]
    # as strict as keeping all but a small share of what it gets right allows, and never stricter than an even bet
    threshold = min(0.5, float(np.quantile(sure.max(axis=1)[right], false_rejections))) if right.any() else 0.0
    return LanguageModel(languages, logits.astype(np.float32), bias, temperature, threshold, bits, longest)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600, **options) -> LanguageModel | None:
    """Train on at most ``per_language`` documents of each language, none of them held out.

    Only the text and the label of documents with both are used.  The sample is bounded by the number of languages,
    which is why it may come to the driver.
    """
    rows = docs.filter(~held_out(F.col(doc_id)) & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = sorted(sample_per_label(rows, "lang", per_language).select("doc_id", "lang", "text").collect())
    return train([r["text"] for r in sample], [r["lang"] for r in sample], **options) if sample else None


def scorer(model: LanguageModel | None):
    """A pandas UDF from texts to ``lang_pred, score, rejected``."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                if model is None or not has_letter(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                total, many = np.zeros(len(model.languages)), 0
                for buckets in subword_buckets(text, model.bits, model.longest):
                    total += model.logits[buckets].sum(axis=0, dtype=np.float64)
                    many += len(buckets)
                sure = softmax((total / max(many, 1) + model.bias) / model.temperature)
                best = int(sure.argmax())
                out.append((model.languages[best], float(sure[best]), bool(sure[best] < model.threshold)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with a predicted language, its calibrated probability and whether it is rejected.

    A null or empty text, or one without a letter, gets ``und`` with score 0 and is rejected; so does every text when
    there is no model (nothing labelled to learn from).  Any other text gets a learned language, of ties the first by
    name, and is rejected when its probability is below the calibrated threshold.  Columns of ``docs`` called like
    ``names`` are replaced; all others pass through.
    """
    mark, = fresh(docs, "_scored")
    scored = docs.withColumn(mark, scorer(model)(F.col(text)))
    out = scored.withColumns({n: F.col(mark)[field] for n, field in zip(names, ("lang_pred", "score", "rejected"), strict=True)})
    return out.drop(mark)
