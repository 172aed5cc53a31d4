"""Alignment of two tokenizers' tokens over a corpus, by merge-path partitioning.

A document is two rising lists, the byte offsets at which its A tokens and its B tokens end.  Merging them gives all
overlaps: between two neighbouring offsets of the merged list lies a part of one A token and of one B token.  Diagonals
of the merge grid divide this merge: a binary search on each finds where it crosses the merge's path, and what lies
between two crossings is a piece of its own with equally many steps.  Pieces are rows of a written table, so Spark deals
them out by size, however long a document is.  Each piece emits its overlaps; groups of tokens that end together are
closed inside pieces, and what is open at the edges of pieces is stitched along the document.

How many documents hold a pair of ids linked is counted over all pieces.  The most frequent pairs, up to a bound, go to
the tasks as a broadcast table; all others are looked up by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hilbert_packing import byte_signs

#: steps of the merge in one piece; characters that go to the tokenizers at once; pairs that are broadcast; pairs a task holds while counting
STEPS, SLICE, FREQUENT, HELD = 1 << 16, 1 << 15, 1 << 19, 1 << 20
#: a letter after one space after no white space: neither tokenizer makes a token across the start of this space
SAFE = re.compile(r"(?<=\S) (?=[A-Za-z])")
#: up to here (Latin scripts) the fast splitter of A is known to agree with the tokenizer of A
LATIN = re.compile("[\u0000-ͯ]*")
#: how A splits a text before it merges (a fixed value of this vocabulary)
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: width of an id in decimal with the sign after it
WIDTH = 6
NONE = np.empty(0, dtype=np.int64)


# --- tokens ------------------------------------------------------------------


class Tokenizers:
    """Both tokenizers and the bytes of all their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = {sign: byte for byte, sign in byte_signs().items()}
        self.bytes_a = {i: bytes(plain[c] for c in token) for token, i in model["vocab"].items() if all(c in plain for c in token)}
        for i in {self.a.token_to_id(t) for t in self.a.get_vocab()} - self.bytes_a.keys():
            self.bytes_a[i] = self.a.id_to_token(i).encode()
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        # ids of this vocabulary are in the order of its merges, so they serve as ranks
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={t: i for i, t in self.bytes_a.items() if i not in special}, special_tokens={})
        self.bytes_b = {i: self._piece(i) for i in range(self.b.vocab_size())}
        self.len_a, self.len_b = lengths(self.bytes_a), lengths(self.bytes_b)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B; none if either does not give back a space and ``text``."""
        a, b = [], []
        for part in slices(text) if text else []:
            spaced = " " + part
            wanted = spaced.encode("utf-8", "surrogatepass")
            ids_a = self.fast.encode_ordinary(spaced) if LATIN.fullmatch(part) else self.a.encode(spaced, add_special_tokens=False).ids
            ids_b = self.b.encode(part, num_threads=1)
            # A is made of bytes and cannot change any, so its lengths tell whether all are there
            a.append(np.fromiter(ids_a, dtype=np.int64, count=len(ids_a)))
            if self.len_a[a[-1]].sum() != len(wanted) or b"".join(map(self.bytes_b.__getitem__, ids_b)) != wanted:
                return NONE, NONE
            b.append(np.fromiter(ids_b, dtype=np.int64, count=len(ids_b)))
        return (np.concatenate(a), np.concatenate(b)) if a else (NONE, NONE)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` cut at safe spaces (which are dropped), the first one from every ``size`` characters on."""
    start = 0
    while m := SAFE.search(text, start + size):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def lengths(of: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(of) + 1, dtype=np.int64)
    for i, token in of.items():
        out[i] = len(token)
    return out


# --- the merge ---------------------------------------------------------------


def merge_path(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the path of merging ``a`` with ``b`` crosses every ``steps``-th diagonal: how many of each lie before, both ends included.

    One binary search a diagonal.  Of equal offsets the one of ``a`` comes first, and the one of ``b`` goes to the same side.
    """
    d = np.arange(steps, len(a) + len(b), steps)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        first = a[np.where(open_, middle, 0)] <= b[np.where(open_, d - 1 - middle, 0)]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, d - low
    if len(d):
        tied = (i > 0) & (j < len(b))
        j = j + (tied & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)]))
    return np.concatenate(([0], i, [len(a)])), np.concatenate(([0], j, [len(b)]))


class Piece:
    """One piece of a document's merge: the tokens that end in it and, at its edge, those it only begins."""

    def __init__(self, row: tuple, len_a: np.ndarray, len_b: np.ndarray, expand: zstandard.ZstdDecompressor) -> None:
        n_a, n_b, start_a, start_b, a, b = row
        self.ids_a, self.ids_b = (np.frombuffer(expand.decompress(x), dtype="<u2").astype(np.int64) for x in (a, b))
        self.a, self.b = self.ids_a[:n_a], self.ids_b[:n_b]
        self.ends_a, self.ends_b = start_a + np.cumsum(len_a[self.a]), start_b + np.cumsum(len_b[self.b])
        #: the B token in which each A token ends
        self.in_b = np.searchsorted(self.ends_b, self.ends_a)
        both = self.ends_b[np.minimum(self.in_b, max(n_b - 1, 0))] == self.ends_a if n_a and n_b else np.zeros(n_a, dtype=bool)
        #: how many A and B tokens end at or before each offset where both end
        self.upto_a, self.upto_b = np.flatnonzero(both) + 1, self.in_b[both] + 1

    def pairs(self, size_b: int) -> np.ndarray:
        """``a * size_b + b`` of all overlaps: each stretch between merged ends belongs to the token that ends there and the one it ends in."""
        alone = np.ones(len(self.b), dtype=bool)
        alone[self.upto_b - 1] = False
        in_a = np.searchsorted(self.ends_a, self.ends_b[alone])
        return np.concatenate((self.a * size_b + self.ids_b[self.in_b], self.ids_a[in_a] * size_b + self.b[alone]))

    def text(self, start: int, end: int, signs: tuple[np.ndarray, ...]) -> bytes:
        """The closed groups from ``start`` to before ``end``, each ended by a semicolon."""
        if start >= end:
            return b""
        comma, bar, semicolon = signs
        last_a, last_b = self.upto_a[start:end], self.upto_b[start:end]
        a0, b0 = (self.upto_a[start - 1], self.upto_b[start - 1]) if start else (0, 0)
        a, b = self.a[a0 : last_a[-1]], self.b[b0 : last_b[-1]]
        sign_a, sign_b = comma[a], comma[b]
        sign_a[last_a - a0 - 1], sign_b[last_b - b0 - 1] = bar[a[last_a - a0 - 1]], semicolon[b[last_b - b0 - 1]]
        # A tokens of a group follow the B tokens of those before, B tokens the A tokens of their own
        size_a, size_b = np.diff(last_a, prepend=a0), np.diff(last_b, prepend=b0)
        out = np.empty(len(a) + len(b), dtype=comma.dtype)
        out[np.arange(len(a)) + np.repeat(last_b - b0 - size_b, size_a)] = sign_a
        out[np.arange(len(b)) + np.repeat(last_a - a0, size_b)] = sign_b
        return out.tobytes().translate(None, b"\0")


def sign_tables(size: int) -> tuple[np.ndarray, ...]:
    """The decimals of all ids below ``size`` followed by a comma, a bar and a semicolon, filled up with zero bytes."""
    return tuple(np.array([f"{i}{sign}" for i in range(size)], dtype=f"S{WIDTH}") for sign in ",|;")


# --- Spark -------------------------------------------------------------------

PIECES = "row long, doc string, piece int, pieces int, n_a int, n_b int, start_a long, start_b long, a binary, b binary"


def pieces(rows: DataFrame, path_a: str, path_b: str, steps: int = STEPS) -> DataFrame:
    """The pieces of all texts (``row, doc, text``), at least one each; ``a`` and ``b`` hold ids, one more than end in the piece where one begins."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers, squeeze = Tokenizers(path_a, path_b), zstandard.ZstdCompressor(level=1)
        len_a, len_b = tokenizers.len_a, tokenizers.len_b
        for batch in batches:
            out, held = [], 0
            for row, doc, text in zip(batch["row"].to_list(), batch["doc"], batch["text"], strict=True):
                a, b = tokenizers.encode(text)
                ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
                i, j = merge_path(ends_a, ends_b, steps)
                for k in range(len(i) - 1):
                    at_a, at_b = int(i[k]), int(j[k])
                    packed = [squeeze.compress(x[s : e + 1].astype("<u2").tobytes()) for x, s, e in ((a, at_a, int(i[k + 1])), (b, at_b, int(j[k + 1])))]
                    out.append((row, doc, k, len(i) - 1, int(i[k + 1]) - at_a, int(j[k + 1]) - at_b, int(ends_a[at_a - 1]) if at_a else 0, int(ends_b[at_b - 1]) if at_b else 0, *packed))
                    held += sum(map(len, packed))
                if held > 1 << 22:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInPandas(split, PIECES)


def _each(batch: pd.DataFrame, len_a: np.ndarray, len_b: np.ndarray) -> Iterator[tuple[int, int, int, Piece]]:
    expand = zstandard.ZstdDecompressor()
    for row, piece, of, *rest in batch[["row", "piece", "pieces", "n_a", "n_b", "start_a", "start_b", "a", "b"]].itertuples(index=False):
        yield row, piece, of, Piece(rest, len_a, len_b, expand)


def pair_counts(cut_pieces: DataFrame, path_a: str, path_b: str, held: int = HELD) -> DataFrame:
    """``pair, n``: how many documents hold a pair of ids linked.

    A task adds up what it sees before it hands on, at most ``held`` distinct pairs at a time.  Pairs of documents of
    several pieces are made distinct first.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = Tokenizers(path_a, path_b)
        len_a, len_b = tokenizers.len_a, tokenizers.len_b
        del tokenizers
        seen, counts, new, waiting = NONE, NONE, [], 0

        def add() -> None:
            nonlocal seen, counts, new, waiting
            if new:
                pair, n = np.unique(np.concatenate(new), return_counts=True)
                both, back = np.unique(np.concatenate((seen, pair)), return_inverse=True)
                total = np.zeros(len(both), dtype=np.int64)
                np.add.at(total, back, np.concatenate((counts, n)))
                seen, counts, new, waiting = both, total, [], 0

        for batch in batches:
            for row, _, of, piece in _each(batch, len_a, len_b):
                pair = np.unique(piece.pairs(len(len_b)))
                if of > 1:
                    yield pd.DataFrame({"pair": pair, "row": row, "n": 1})
                    continue
                new.append(pair)
                waiting += len(pair)
                if waiting > held:
                    add()
                if len(seen) > held:
                    yield pd.DataFrame({"pair": seen, "row": -1, "n": counts})
                    seen, counts = NONE, NONE
        add()
        yield pd.DataFrame({"pair": seen, "row": -1, "n": counts})

    found = cut(cut_pieces.mapInPandas(count, "pair long, row long, n long"))
    several = found.filter("row >= 0").select("pair", "row").distinct().select("pair", F.lit(1).cast("long").alias("n"))
    return found.filter("row < 0").select("pair", "n").union(several).groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_pairs(counted: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have this count or more."""
    sizes = {r["p"]: r["n"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    power, total = max(sizes, default=0) + 1, 0
    while power > 0 and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of every document of several pieces; its pieces come in order, one batch after the other."""
    at, digest, open_a, open_b, any_ = None, None, [], [], False

    def close() -> tuple[int, str]:
        return at, digest.hexdigest() if any_ else hashlib.sha256(b"").hexdigest()

    for batch in batches:
        out = []
        for row, closed, head_a, head_b, middle, tail_a, tail_b in batch[["row", "closed", "head_a", "head_b", "middle", "tail_a", "tail_b"]].itertuples(index=False):
            if row != at:
                if at is not None:
                    out.append(close())
                at, digest, open_a, open_b, any_ = row, hashlib.sha256(), [], [], False
            if closed:
                open_a.append(head_a)
                open_b.append(head_b)
                group = b",".join(filter(None, open_a)) + b"|" + b",".join(filter(None, open_b))
                digest.update(b";" * any_ + group + (b";" + middle[:-1] if middle else b""))
                open_a, open_b, any_ = [], [], True
            open_a.append(tail_a)
            open_b.append(tail_b)
        yield pd.DataFrame(out, columns=["row", "groups_sha256"])
    if at is not None:
        yield pd.DataFrame([close()], columns=["row", "groups_sha256"])


def align(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", steps: int = STEPS, frequent: int = FREQUENT, held: int = HELD
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``path_a`` is a byte-level BPE file and ``path_b`` a sentencepiece model that puts a space before a text; A reads a
    space and the text.  Special tokens in a text are plain text.  Groups are cut where tokens of both end.  A link is a
    pair of tokens whose bytes overlap; its count is how many documents hold its pair of ids linked, and it is a best
    one if no pair with its A id has a higher count.

    Null and empty texts, and those that either tokenizer does not give back byte by byte, have zeros and an empty
    string.  Rows that repeat are documents of their own, with or without a ``doc_id``.  Other columns are not read.  An
    empty table gives an empty table.  Long texts go to the tokenizers in slices that do not change their tokens.  The
    digest of a document's groups is one stream by definition: its pieces pass through one task, one after the other.
    """
    context = docs.sparkSession.sparkContext
    # an id as text passes through pandas unchanged, null or not
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").cast("string").alias("doc"), F.col(text).alias("text"))
    parts = cut(pieces(rows, path_a, path_b, steps))
    ids = parts.filter("piece = 0").select("row", F.col("doc").cast("long").alias("doc_id"))
    counted = cut(pair_counts(parts, path_a, path_b, held))
    size_b = Tokenizers(path_a, path_b).b.vocab_size()
    # at most one row for each id of A
    best = counted.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("top"))
    judged = cut(counted.withColumn("a", F.floor(F.col("pair") / size_b)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    least = frequent_pairs(judged, frequent)
    known = judged.filter(F.col("n") >= least).orderBy("pair").toArrow()
    sent = context.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = Tokenizers(path_a, path_b)
        len_a, len_b = tokenizers.len_a, tokenizers.len_b
        del tokenizers
        signs, (known_pair, known_n, known_best) = sign_tables(max(len(len_a), len(len_b))), sent.value
        listed = lambda x: b",".join(b"%d" % i for i in x.tolist())
        for batch in batches:
            out = []
            for row, number, of, p in _each(batch, len_a, len_b):
                linked = p.pairs(len(len_b))
                pair, times = np.unique(linked, return_counts=True)
                at = np.minimum(np.searchsorted(known_pair, pair), max(len(known_pair) - 1, 0))
                hit = known_pair[at] == pair if len(known_pair) else np.zeros(len(pair), dtype=bool)
                total = int((known_n[at[hit]] * times[hit]).sum())
                n_best = int((known_best[at[hit]] * times[hit]).sum())
                groups = len(p.upto_a)
                whole, head_a, head_b, middle, tail_a, tail_b = None, None, None, None, None, None
                if of == 1:
                    text_ = p.text(0, groups, signs)
                    whole = hashlib.sha256(text_[:-1]).hexdigest() if groups else ""
                else:
                    if groups:
                        head_a, head_b, middle = listed(p.a[: p.upto_a[0]]), listed(p.b[: p.upto_b[0]]), p.text(1, groups, signs)
                    tail_a, tail_b = (listed(x[u[-1] if groups else 0 :]) for x, u in ((p.a, p.upto_a), (p.b, p.upto_b)))
                out.append((row, number, len(p.a), len(p.b), groups, len(linked), n_best, total, pair[~hit], times[~hit], whole, groups > 0, head_a, head_b, middle, tail_a, tail_b))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    kind = (
        "row long, piece int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, rest array<long>, times array<long>, "
        "groups_sha256 string, closed boolean, head_a binary, head_b binary, middle binary, tail_a binary, tail_b binary"
    )
    scored = cut(parts.mapInPandas(score, kind))
    # pairs beyond the broadcast table are rare, so none of their keys is hot
    rest = scored.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("z")).select("row", F.col("z.rest").alias("pair"), F.col("z.times").alias("times"))
    rest = rest.join(judged.filter(F.col("n") < least), "pair").select("row", (F.col("n") * F.col("times")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    stitched = scored.filter("groups_sha256 is null").select("row", "piece", "closed", "head_a", "head_b", "middle", "tail_a", "tail_b")
    stitched = stitched.repartition("row").sortWithinPartitions("row", "piece").mapInPandas(_stitch, "row long, groups_sha256 string")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    facts = ("n_a", "n_b", "n_groups", "n_links")
    every = scored.select("row", *facts, "n_best", "count_sum", "groups_sha256")
    every = every.union(rest.select("row", *[zero.alias(f) for f in facts], "n_best", "count_sum", none.alias("groups_sha256")))
    every = every.union(stitched.select("row", *[zero.alias(f) for f in facts], zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256"))
    summed = every.groupBy("row").agg(*[F.sum(f).alias(f) for f in (*facts, "n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256"))
    return ids.join(summed, "row").select("doc_id", *facts, "n_best", "count_sum", "groups_sha256")
