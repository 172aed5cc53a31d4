"""Hashed words and subwords of whole texts, and labelled samples, for the classifiers.

Corpora have too many distinct words to remember them all, so nothing here keeps a
table of words: a text becomes an array of bytes, and the hashes of all its words or
n-grams come from a few array operations, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: bytes of a text that are hashed at a time
BLOCK = 1 << 19
BLANK, LETTER, DIGIT = 32, 120, 57
_codes = np.arange(256, dtype=np.uint8)
_upper, _lower, _digit = (_codes >= 65) & (_codes <= 90), (_codes >= 97) & (_codes <= 122), (_codes >= 48) & (_codes <= 57)
IS_BLANK = (_codes == 32) | ((_codes >= 9) & (_codes <= 13))
#: letters in lower case; bytes of other than ASCII characters count as letters; everything else is 0
LETTERS = np.where(_upper, _codes + 32, np.where(_lower | (_codes >= 128), _codes, 0)).astype(np.uint64)
#: what a byte looks like: x, X, 9, or itself
LOOKS = np.where(_upper, 88, np.where(_lower | (_codes >= 128), LETTER, np.where(_digit, DIGIT, _codes))).astype(np.uint64)
#: letters stay, everything else is a blank
ONLY_LETTERS = bytes(c if l else BLANK for c, l in zip(range(256), LETTERS.tolist(), strict=True))

STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + 64, STEP)]))
    INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + 64, BACK)]))


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of about ``BLOCK`` bytes that end after a blank where there is one; a longer word is cut."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            end = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end)) + 1
            end = end if end > at else at + BLOCK
        yield data[at:end]
        at = end


def word_hashes(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of one block: the bucket of its letters (0: none), the bucket of its shape, and a hash of all of it.

    A word is a run of other than ASCII blanks.  Its shape is what its bytes look like with runs of one look collapsed.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], ~IS_BLANK[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    word = np.cumsum(inside[1:-1] & ~inside[:-2]) - 1
    here = np.flatnonzero(inside[1:-1])
    owner = word[here]
    first = np.searchsorted(here, starts)
    with np.errstate(over="ignore"):
        weight = POWERS[here]
        undo = INVERSES[starts]
        letters = np.add.reduceat(LETTERS[raw[here]] * weight, first) * undo
        whole = np.add.reduceat((raw[here].astype(np.uint64) + np.uint64(1)) * weight, first) * undo
        looks = LOOKS[raw[here]]
        new = np.concatenate([[True], (looks[1:] != looks[:-1]) | (owner[1:] != owner[:-1])])
        kept = np.flatnonzero(new)
        at = np.searchsorted(owner[kept], np.arange(len(starts)))
        rank = np.arange(len(kept)) - at[owner[kept]]
        shape = np.add.reduceat(looks[kept] * POWERS[np.minimum(rank, BLOCK)], at)
    own = _mixed(letters, bits)
    own[letters == 0] = 0
    return own, _mixed(shape + np.uint64(7), bits), whole


def subword_buckets(text: str, bits: int, longest: int) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of 2 to ``longest`` bytes inside the text's words, block by block.

    A word is a run of letters in lower case between two marks, and an n-gram may have a mark at its ends only.
    """
    data = text.lower().encode("utf-8", "replace").translate(ONLY_LETTERS)
    for block in blocks(data):
        a = np.frombuffer(b" " + block + b" ", dtype=np.uint8)
        mark = a == BLANK
        value = a.astype(np.uint64)
        inner = np.ones(len(a), dtype=bool)
        out = []
        for n in range(2, longest + 1):
            if len(a) < n:
                break
            value = value[:-1] * np.uint64(256) + a[n - 1 :]
            # everything but the two ends is a letter
            inner = inner[:-1] & (~mark[n - 2 : -1] if n > 2 else True)
            fits = inner & ~(mark[: len(value)] & mark[n - 1 :])
            with np.errstate(over="ignore"):
                out.append(_mixed((value[fits] + np.uint64(n)) * STEP, bits))
        yield np.concatenate(out)


def sample_per_label(docs: DataFrame, label: str, per_label: int, doc_id: str = "doc_id", slices: int = 16) -> DataFrame:
    """About ``per_label`` rows of ``docs`` (at most, rounded up to ``slices``) for each value of ``label``, always the same.

    Ids are dealt into slices by a hash, and every slice of a label gives its share of smallest hashes, so a frequent
    label is ranked in as many tasks.  Only ids take part; rows whose label or id is null are left out.
    """
    rank, mark = fresh(docs, "_rank", "_picked")
    ids = docs.select(F.col(doc_id).alias(mark), F.col(label).alias("label")).filter(F.col(mark).isNotNull() & F.col("label").isNotNull())
    ids = ids.withColumn("slice", F.pmod(F.xxhash64(F.lit(3), mark), F.lit(slices)))
    order = Window.partitionBy("label", "slice").orderBy(F.xxhash64(mark), mark)
    picked = ids.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= -(-per_label // slices)).select(mark).distinct()
    # written, so the planner knows how small it is and need not shuffle the texts
    return docs.filter(F.col(label).isNotNull()).join(cut(picked), docs[doc_id] == F.col(mark), "left_semi")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, from a grid, under which ``softmax(logits / t)`` gives ``labels`` the largest likelihood."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
