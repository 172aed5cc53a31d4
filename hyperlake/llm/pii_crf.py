"""Personal data: exact patterns and a semi-Markov conditional random field.

Four kinds are defined by patterns (:func:`base_spans`); those spans always stay.  The
field finds what patterns miss.  It works on *zones*, stretches of atoms (words, with
punctuation split off) around digits and ``@``: a segment is up to ``LONGEST`` atoms of
one line with such a sign in it, so the text between zones can only be outside and
zones decode apart from each other, whatever the length of the text.

Features look at a whole candidate segment (shape, lengths, checksums, letter and digit
mix) and at its neighbours.  A label pair scores each step.  Boundaries and types are
chosen together by dynamic programming over segment ends with the segment length
bounded.  Training maximises the likelihood of zones whose labels come from the
patterns and from a few seeds for credentials; the features do not see those patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, share_of

KINDS = ("email", "ip", "card", "phone")
#: labels of the field; 0 is outside
LABELS = ("out", *KINDS, "secret")
LONGEST, AROUND, BUCKETS = 8, 3, 1 << 14

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match starts at the first digit of a run or nowhere in it, so later starts need no try
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
CHUNK, BLANK = re.compile(r"\S+"), re.compile(r"\s")
ATOM = re.compile(r"[^\s\"'`()\[\]{}<>,;:=!?|]+|[^\s]")
#: training labels of credentials
SEEDS = (re.compile(r"\bAKIA[0-9A-Z]{16}\b"), re.compile(r"(?<=password=)\S{8,}"), re.compile(r"(?<=token = \")[^\"\s]{16,}"))


# --- patterns ----------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part runs back from ``@`` to the last match or to a character outside the class; no other start can match."""
    end, at = 0, text.find("@")
    while at >= 0:
        width = 64
        while True:
            base = max(end, at - width)
            low = base + len(text[base:at].rstrip(LOCAL))
            if low > base or base == end:
                break
            width *= 4
        if low < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield low, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, sorted; ends are exclusive, offsets count code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if SIGN.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m.group())]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m.group())) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return sorted(out)


# --- zones and features ------------------------------------------------------


def zones(text: str) -> Iterator[list[tuple[int, int]]]:
    """Atoms (start, end) of every stretch around digits and ``@``, with ``AROUND`` words of context to either side."""
    done, sign = 0, SIGN.search(text)
    while sign:
        start = max(done, sign.start() - 60)
        if start > done:
            gap = BLANK.search(text, start, sign.start())
            # no blank in sight: the word goes back further than the context does
            start = gap.start() if gap else max(done, *(text.rfind(c, done, start) + 1 for c in " \n\t"))
        words, calm, stop = [], 0, start
        for m in CHUNK.finditer(text, start):
            words.append((m.start(), m.end()))
            stop = m.end()
            calm = 0 if SIGN.search(text, m.start(), m.end()) else calm + 1
            if calm >= AROUND and m.start() > sign.start():
                break
        first = next(k for k, w in enumerate(words) if w[1] > sign.start())
        atoms = [(a.start(), a.end()) for w in words[max(0, first - AROUND) :] for a in ATOM.finditer(text, *w)]
        yield atoms
        done = stop
        sign = SIGN.search(text, done)


@cache
def _bucket(feature: str) -> int:
    return crc32(feature.encode("utf-8", "replace")) % BUCKETS


def _bucket_of(feature: str) -> int:
    return _bucket(feature) if len(feature) < 24 else crc32(feature.encode("utf-8", "replace")) % BUCKETS


def shape(s: str) -> str:
    """Letters and digits as x, X and 9, runs collapsed, at most 24 signs."""
    out = []
    for c in s[:200]:
        k = "9" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:24])


def _step(n: float) -> int:
    return int(math.log2(n + 1) * 2)


def segment_features(text: str, atoms: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Buckets of the features of atoms ``i`` to ``j`` (exclusive) as one segment."""
    s = text[atoms[i][0] : atoms[j - 1][1]]
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    form = shape(s)
    turns = sum(form[k] != form[k + 1] for k in range(len(form) - 1))
    word = lambda k: text[slice(*atoms[k])].lower()[:20] if 0 <= k < len(atoms) else "^"
    one = j - i == 1
    names = [
        "1", f"n{j - i}", f"s{form}", f"d{_step(digits)}", f"l{_step(len(s))}", f"m{_step(digits)},{_step(letters)}", f"t{one}{_step(turns)}{_step(len(s))}", f"a{s.count('@')}{'.' in s[s.find('@') :] if '@' in s else ''}",
        f"p{s.count('.')}", f"h{one}{digits > 0 and letters > 0}{_step(len(s))}{all(c in '0123456789abcdefABCDEF' for c in s)}", f"u{one}{s.upper() == s}{letters > 0}{digits > 0}{_step(len(s))}",
        f"q{one}{letters > 0}{digits > 0}{_step(len(set(s)))}", f"f{form[:2]}", f"e{form[-1:]}", f"<{word(i - 1)}", f"<<{word(i - 2)},{word(i - 1)}", f">{shape(word(j))}", f"<s{shape(word(i - 1))},{form[:2]}", f">s{form[-1:]},{shape(word(j))}",
    ]
    if digits >= 7 and digits + len(re.findall(r"[ .()+-]", s)) == len(s):
        names.append(f"c{luhn(_only_digits(s))}{12 <= digits <= 19}")
        names.append(f"g{'+' == s[0]}{9 <= digits <= 15}")
    if s.count(".") == 3 and digits + 3 == len(s):
        names.append(f"o{all(s.split('.')) and _octets(s)}")
    return [_bucket_of(n) for n in names]


def segments(text: str, atoms: list[tuple[int, int]]) -> list[list[tuple[int, list[int]]]]:
    """For each end the candidate segments ``(length, features)``; a candidate has a digit or ``@`` and stays on its line."""
    signs = [bool(SIGN.search(text, a, b)) for a, b in atoms]
    broken = [False] + ["\n" in text[atoms[k - 1][1] : atoms[k][0]] for k in range(1, len(atoms))]
    out = []
    for j in range(1, len(atoms) + 1):
        here, any_sign = [], False
        for n in range(1, min(LONGEST, j) + 1):
            any_sign = any_sign or signs[j - n]
            if any_sign:
                here.append((n, segment_features(text, atoms, j - n, j)))
            if broken[j - n]:
                break
        out.append(here)
    return out


@dataclass(frozen=True)
class SpanField:
    """``weights``: labels (without outside) by buckets; ``steps``: score of a label after a label."""

    weights: np.ndarray
    steps: np.ndarray


def _scores(field: SpanField, cands: list[list[tuple[int, list[int]]]]) -> list[list[tuple[int, np.ndarray]]]:
    return [[(n, field.weights[:, f].sum(axis=1)) for n, f in here] for here in cands]


def decode(field: SpanField, cands: list[list[tuple[int, list[int]]]]) -> list[tuple[int, int, int]]:
    """The best segmentation: (first atom, end atom, label) of its entities."""
    n = len(cands)
    if not any(cands):
        return []
    best = np.full((n + 1, len(LABELS)), -np.inf)
    back: list[list[tuple[int, int]]] = [[(0, 0)] * len(LABELS) for _ in range(n + 1)]
    best[0, 0] = 0.0
    for j, here in enumerate(_scores(field, cands), 1):
        came = best[j - 1] + field.steps[:, 0]
        k = int(came.argmax())
        best[j, 0], back[j][0] = came[k], (j - 1, k)
        for length, score in here:
            came = best[j - length][:, None] + field.steps[:, 1:]
            ks = came.argmax(axis=0)
            total = came[ks, np.arange(came.shape[1])] + score
            for y in np.flatnonzero(total > best[j, 1:]):
                best[j, y + 1], back[j][y + 1] = total[y], (j - length, int(ks[y]))
    out, j, y = [], n, int(best[n].argmax())
    while j:
        i, before = back[j][y]
        if y:
            out.append((i, j, y))
        j, y = i, before
    return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis=axis)


def expected(field: SpanField, cands: list[list[tuple[int, list[int]]]]) -> tuple[list[tuple[list[int], np.ndarray]], np.ndarray]:
    """Under the field: how likely each candidate is with each label, and each step between labels (forward-backward)."""
    n, scored = len(cands), _scores(field, cands)
    fwd = np.full((n + 1, len(LABELS)), -np.inf)
    fwd[0, 0] = 0.0
    for j, here in enumerate(scored, 1):
        fwd[j, 0] = _lse(fwd[j - 1] + field.steps[:, 0], 0)
        if here:
            fwd[j, 1:] = _lse(np.stack([_lse(fwd[j - m][:, None] + field.steps[:, 1:], 0) + s for m, s in here]), 0)
    whole = _lse(fwd[n], 0)
    bwd = np.full((n + 1, len(LABELS)), -np.inf)
    bwd[n] = 0.0
    likely, steps = [], np.zeros_like(field.steps)
    after: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(n + 1)]
    for j in range(n, 0, -1):
        if after[j]:
            bwd[j] = _lse(np.stack([_lse(field.steps[:, lo : lo + len(v)] + v, 1) for v, lo in after[j]]), 0)
        out = bwd[j, :1]
        after[j - 1].append((out, 0))
        steps[:, 0] += np.exp(fwd[j - 1] + field.steps[:, 0] + out[0] - whole)
        for (m, s), (_, feats) in zip(scored[j - 1], cands[j - 1], strict=True):
            v = s + bwd[j, 1:]
            after[j - m].append((v, 1))
            p = np.exp(fwd[j - m][:, None] + field.steps[:, 1:] + v - whole)
            steps[:, 1:] += p
            likely.append((feats, p.sum(axis=0)))
    return likely, steps


def gold(text: str, atoms: list[tuple[int, int]]) -> list[tuple[int, int, int]] | None:
    """Training segments of a zone, or None where a label does not fall on atom ends."""
    starts, ends = {a: k for k, (a, _) in enumerate(atoms)}, {b: k + 1 for k, (_, b) in enumerate(atoms)}
    low, high = atoms[0][0], atoms[-1][1]
    spans = [(a, b, y + 1) for a, y, b in base_spans(text[low:high])] + [(m.start(), m.end(), len(LABELS) - 1) for seed in SEEDS for m in seed.finditer(text[low:high])]
    out, done = [], 0
    for a, b, y in sorted(spans):
        i, j = starts.get(a + low), ends.get(b + low)
        if i is None or j is None or j - i > LONGEST:
            return None
        if i >= done:
            out.append((i, j, y))
            done = j
    return out


def train(texts: list[str], epochs: int = 4, rate: float = 0.25, seed: int = 3, most_zones: int = 4000) -> SpanField | None:
    """Fit by stochastic gradient ascent on the likelihood of at most ``most_zones`` labelled zones of ``texts``."""
    rows = []
    for text in texts:
        for atoms in zones(text):
            if len(rows) < most_zones and len(atoms) <= 200 and (want := gold(text, atoms)) is not None:
                rows.append((segments(text, atoms), want))
    if not rows:
        return None
    field = SpanField(np.zeros((len(LABELS) - 1, BUCKETS)), np.zeros((len(LABELS), len(LABELS))))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            cands, want = rows[k]
            lr = rate / (1 + step / len(rows))
            step += 1
            likely, steps = expected(field, cands)
            for feats, p in likely:
                if p.max() > 1e-4:
                    field.weights[:, feats] -= lr * p[:, None]
            for i, j, y in want:
                feats = dict(cands[j - 1])[j - i]
                field.weights[y - 1, feats] += lr
            path, at = [], 0
            for i, j, y in want:
                path += [0] * (i - at) + [y]
                at = j
            path += [0] * (len(cands) - at)
            seen = np.zeros_like(steps)
            np.add.at(seen, ([0, *path[:-1]], path), 1)
            field.steps[:] += lr * (seen - steps)
    return field


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = 4000, **options) -> SpanField | None:
    """Train on about ``documents`` documents with a digit or ``@``, picked by a hash of their id; others teach nothing."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = cut(rows.filter(F.col("text").rlike("[0-9@]") & (F.length("text") < 20_000)).select("doc_id").distinct())
    picked = ids.filter(share_of(F.col("doc_id"), documents, ids.count())).withColumnRenamed("doc_id", "picked")
    # about ``documents`` ids, whatever the size of the table
    sample = sorted(r["text"] for r in rows.filter(F.length("text") < 20_000).join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("picked"))).select("text").collect())
    return train(sample, **options) if sample else None


def added_spans(text: str, field: SpanField | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, label, end) of the segments the field finds where no pattern matched."""
    out = []
    for atoms in zones(text) if field is not None else ():
        for i, j, y in decode(field, segments(text, atoms)):
            a, b = atoms[i][0], atoms[j - 1][1]
            if not any(s < b and a < e for s, _, e in base):
                out.append((a, y, b))
    return out


def finder(field: SpanField | None):
    """A pandas UDF from texts to ``spans`` (kind, start, end, base) in order."""

    @F.pandas_udf("array<struct<kind: string, start: long, end: long, base: boolean>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                base = base_spans(text) if text else []
                more = added_spans(text, field, base) if text else []
                rows = [(a, k, KINDS[k], b, True) for a, k, b in base] + [(a, 10 + y, f"crf_{LABELS[y]}", b, False) for a, y, b in more]
                out.append([{"kind": name, "start": a, "end": b, "base": is_base} for a, _, name, b, is_base in sorted(rows)])
            yield pd.Series(out)

    return find


def find_spans(docs: DataFrame, field: SpanField | None, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with an array ``spans`` of ``kind, start, end, base``, by start and then kind.

    Pattern matches have ``base`` true and their own kinds.  Spans of the field are called ``crf_<label>`` and never
    overlap a pattern match.  Null and empty texts have an empty array.  Without a field (no text to learn from) only
    patterns count.  A column of ``docs`` called like ``spans`` is replaced; all others pass through.
    """
    return docs.withColumn(spans, finder(field)(F.col(text)))


def redact(docs: DataFrame, field: SpanField | None, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; of overlapping spans the earlier one counts, and the rest of the later one goes with it."""
    mark, = fresh(docs, "_spans")

    @F.pandas_udf("string")
    def blank(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, found, strict=True):
            done, parts = 0, []
            for s in spans if t else ():
                if s["start"] >= done:
                    parts += [t[done : s["start"]], f"[{s['kind']}]"]
                done = max(done, s["end"])
            out.append("".join([*parts, t[done:]]) if t else t)
        return pd.Series(out, dtype=object)

    return find_spans(docs, field, text, mark).withColumn(text, blank(F.col(text), F.col(mark))).drop(mark)
