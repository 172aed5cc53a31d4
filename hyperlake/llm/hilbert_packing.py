"""Packing documents into sequences along a Hilbert curve.

A document becomes token ids and a hashed vector of them, projected to a few
dimensions.  The coordinates, scaled by their mean and deviation over all documents,
give a position on a Hilbert curve, so neighbours on the curve have alike vectors.
Documents are range-sorted by that key and laid end to end; sequence ``k`` is what lies
between ``k * length`` and ``(k + 1) * length``.  Only the last sequence is padded.

The global positions need no global sort in one task: each range partition adds up its
own tokens, and one small table of partition totals shifts them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: characters of a text that go to the tokenizer at once
SLICE = 1 << 16
BLANKS = r" \t\n\x0b\x0c\r"


def char_class(kind: str, below: int = 0x180) -> str:
    """The Latin characters of a Unicode category (the first letter of its name), for a regular expression."""
    return "".join(re.escape(chr(c)) for c in range(1, below) if unicodedata.category(chr(c))[0] == kind)


LETTERS, NUMBERS = char_class("L"), char_class("N")
#: printable Latin characters and blanks: their lower case is one of them, and normalisation does nothing else to them
PLAIN = re.compile(f"[{BLANKS}!-~\xa1-\u012f\u0131-\u017f]*")
#: how the tokenizer splits a text in lower case before it merges (a fixed value of this vocabulary)
PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
BREAK, WORD = re.compile(f"[{BLANKS}]"), re.compile(f"[^{BLANKS}]+")
#: ends a part, as it occurs in no plain text
MARK = "\0"
BUCKETS, DIMS, ORDER = 256, 3, 16


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    The tokenizer makes no token across a blank, so a text can be cut at any.  Plain texts are split into parts by one
    regular expression, and every part gets a mark at its end.  With the mark as a byte, the vocabulary's tokens that end
    a word are ordinary tokens of bytes, and ids that rise with the order of merges serve as their ranks, so a faster
    merger gives the same ids.  Words with other characters, or with what might be a special token, go through the
    tokenizer itself.  Nothing is remembered between texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = {sign: byte for byte, sign in byte_signs().items()}
        ranks = {bytes(plain.get(c, 0) for c in t.removesuffix("</w>")) + MARK.encode() * t.endswith("</w>"): i for t, i in vocab.items()}
        # a tokenizer that prepares words in another way is only used as a whole
        probe = ["Abc", "\u00c9\u00df\u00fc", "word,", "...", "a\u00e9!?", "%%%", "zz;", "it's 12\u00b2"]
        self.fast = None
        if len(ranks) == len(vocab) and all(bytes([b]) in ranks for b in range(256)):
            self.fast = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
            if any(self._merged(w) != self._whole(w) for w in probe):
                self.fast = None

    def _merged(self, text: str) -> list[int]:
        parts = PARTS.findall(text.lower())
        parts.append("")
        return self.fast.encode_ordinary(MARK.join(parts))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, text: str) -> list[int]:
        """Ids of a text with some odd words: what lies between them is plain."""
        out, plain = [], []
        for m in WORD.finditer(text):
            if PLAIN.fullmatch(m[0]) and "<|" not in m[0]:
                plain.append(m[0])
                continue
            out += self._merged(" ".join(plain)) + self._whole(m[0])
            plain = []
        return out + self._merged(" ".join(plain))

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut_ = BREAK.search(text, at + SLICE)
            end = cut_.start() if cut_ else len(text)
            part = text[at:end]
            if self.fast is None:
                ids = self._whole(part)
            else:
                ids = self._merged(part) if PLAIN.fullmatch(part) and "<|" not in part else self._words(part)
            out.append(np.array(ids, dtype="<u4").tobytes())
            at = end
        return b"".join(out)


def projection(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def bucket_table(size: int = 1 << 20) -> np.ndarray:
    """The hash bucket of every token id below ``size``; ids beyond share the buckets of their remainders."""
    with np.errstate(over="ignore"):
        return ((np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def coordinates(ids: np.ndarray, onto: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the hashed, damped and normalised token counts fall."""
    counts = np.sqrt(np.bincount(table[ids & np.uint32(len(table) - 1)], minlength=BUCKETS))
    return counts @ onto / max(float(np.linalg.norm(counts)), 1e-9)


def hilbert(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Position on the Hilbert curve of integer ``points`` (rows) with ``order`` bits a coordinate (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (order - 1)
    while bit > 1:
        low = bit - 1
        for k in range(n):
            up = (x[k] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(up, low, 0) ^ swap
            x[k] ^= swap if k else 0
        bit >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (order - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for k in range(n):
            key = key << 1 | (x[k] >> b & 1)
    return key


def encoded(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """``row, doc_id, tokens, packed, x``: compressed ids and projected vector of every row; written to the shared folder."""

    @F.pandas_udf("packed binary, tokens long, x array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, squeeze, onto, table = Encoder(tokenizer), zstandard.ZstdCompressor(level=1), projection(), bucket_table()
        end = np.array([end_id], dtype="<u4").tobytes()
        for texts in batches:
            out = []
            for t in texts:
                ids = (words.encode(t) if t else b"") + end
                out.append((squeeze.compress(ids), len(ids) // 4, coordinates(np.frombuffer(ids, dtype="<u4"), onto, table)))
            yield pd.DataFrame(out, columns=["packed", "tokens", "x"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), encode(F.col(text)).alias("e"))
    return cut(rows.select("row", "doc_id", "e.packed", "e.tokens", "e.x"))


def curve_order(rows: DataFrame) -> DataFrame:
    """``row, first``: how many tokens lie before each row along the curve."""
    mean = [F.avg(F.col("x")[k]) for k in range(DIMS)]
    spread = [F.stddev_pop(F.col("x")[k]) for k in range(DIMS)]
    stats = rows.agg(F.array(*mean).alias("m"), F.array(*spread).alias("s")).first()
    middle = np.array([v or 0.0 for v in stats["m"]])
    scale = np.maximum(np.array([v or 0.0 for v in stats["s"]]), 1e-12)

    @F.pandas_udf("long")
    def key(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        # about four deviations to either side
        grid = (np.clip((np.stack(x.to_list()) - middle) / scale / 8 + 0.5, 0, 1 - 1e-9) * (1 << ORDER)).astype(np.int64)
        return pd.Series(hilbert(grid))

    keyed = cut(rows.select("row", "doc_id", "tokens", key("x").alias("key")))

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for b in batches:
            after = b["tokens"].cumsum()
            yield pd.DataFrame({"row": b["row"], "part": b["part"], "tokens": b["tokens"], "before": before + after - b["tokens"]})
            before += int(after.iloc[-1]) if len(b) else 0

    order = ["key", "doc_id", "row"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "tokens", F.spark_partition_id().alias("part"))
    placed = cut(ranged.mapInPandas(running, "row long, part int, tokens long, before long"))
    totals = placed.groupBy("part").agg(F.sum("tokens").alias("sum"))
    # one row for each range partition
    shift = totals.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    return placed.join(shift, "part").select("row", (F.col("before") + F.col("shift")).alias("first"))


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 4096, end_id: int = 2) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: the pieces of all documents, every id in one piece.

    ``tokenizer`` is the path of a tokenizer file.  A document is its token ids (null and empty texts have none) and
    ``end_id``; ``ids`` are those of the piece as little-endian unsigned 32-bit numbers.  Pieces fill each sequence
    without a gap from offset 0.  Every row is a document of its own: rows that repeat, also with their id, are packed
    as often as they occur, and of documents at one place of the curve the one with the smaller id comes first.  Other
    columns are not read.  An empty table gives an empty table.
    """
    rows = encoded(docs, doc_id, text, tokenizer, end_id)
    whole = rows.select("row", "doc_id", "packed", "tokens").join(curve_order(rows), "row")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for d, packed, n, first in zip(b["doc_id"], b["packed"], b["tokens"].to_list(), b["first"].to_list(), strict=True):
                ids, at = expand.decompress(packed), 0
                while at < n:
                    sequence, offset = divmod(first + at, length)
                    size = min(length - offset, n - at)
                    out.append((d, at, size, ids[4 * at : 4 * (at + size)], n, sequence, offset))
                    at += size
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    pieces = whole.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(cut_up, kind)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
