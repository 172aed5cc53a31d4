"""Alignment of tokens against loops over offsets, with the tokenizers run on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from hyperlake.llm import queries, token_alignment
from hyperlake.llm.common import table

PATHS = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))
KIND = "doc_id long, text string"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.Tokenizers(*PATHS)


def brute(docs, t):
    read = []
    for d, text in docs:
        ids_a = t.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = t.b.encode(text, num_threads=1) if text else []
        bytes_a, bytes_b = [t.bytes_a[i] for i in ids_a], [t.bytes_b[i] for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            read.append((d, [], [], [], []))
            continue
        spans_a, spans_b, links, groups = [], [], [], []
        for tokens, spans in ((bytes_a, spans_a), (bytes_b, spans_b)):
            at = 0
            for x in tokens:
                spans.append((at, at + len(x)))
                at += len(x)
        j = 0
        for k, (s, e) in enumerate(spans_a):
            while spans_b[j][1] <= s:
                j += 1
            m = j
            while m < len(spans_b) and spans_b[m][0] < e:
                links.append((ids_a[k], ids_b[m]))
                m += 1
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        i = j = 0
        for c in cuts:
            a, b = [], []
            while i < len(ids_a) and spans_a[i][1] <= c:
                a.append(str(ids_a[i]))
                i += 1
            while j < len(ids_b) and spans_b[j][1] <= c:
                b.append(str(ids_b[j]))
                j += 1
            groups.append(",".join(a) + "|" + ",".join(b))
        read.append((d, ids_a, ids_b, links, groups))
    counts = Counter(p for *_, links, _ in read for p in set(links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return sorted(
        ((d, len(a), len(b), len(g), len(ls), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, ls, g in read), key=str
    )


def as_tuples(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


ODD = [
    (1, "the same text"), (2, "the same text"), (2, "the same text"), (3, None), (4, ""), (5, " "), (6, "a mark ▁ that is a space to B"), (7, "<|endoftext|> </s> <s> <unk> <0x41>"), (8, "日本語のテキスト と English 混ぜて 😀👩‍👩‍👧"),
    (None, "no id"), (9, "tabs\tand\n\nlines  two   three spaces \r\n end "), (10, "\x00\x1c\x85\xa0 nul"), (11, "x" * 3000), (12, "word é don't I'll 123 12,5 " * 400), (13, "नमस्ते दुनिया ١٢٣"),
]


@pytest.mark.parametrize("small", [{}, {"steps": 7, "frequent": 16, "held": 50}])
def test_alignment(spark, tokenizers, small):
    df = spark.createDataFrame(ODD, KIND).repartition(4)
    for n in ("row", "piece", "pair", "n", "a", "b"):
        df = df.selectExpr("*", f"'x' as `{n}`")
    assert as_tuples(token_alignment.align(df, *PATHS, **small)) == brute(ODD, tokenizers)


def test_query_on_a_small_table(spark, tokenizers):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert as_tuples(queries.op13_alignment(spark, "/root/testdata/sf0.001")) == brute(docs, tokenizers)


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], KIND), *PATHS).count() == 0


def test_merge_path_pieces_are_equal_and_keep_ties_together():
    r = random.Random(1)
    for _ in range(200):
        n = r.randrange(1, 60)
        a, b = (np.array(sorted({*r.sample(range(1, n + 1), r.randrange(n)), n})) for _ in range(2))
        i, j = token_alignment.merge_path(a, b, 5)
        assert i[0] == j[0] == 0 and i[-1] == len(a) and j[-1] == len(b)
        for k in range(1, len(i) - 1):
            assert i[k] + j[k] in (5 * k, 5 * k + 1)
            before, after = [*a[: i[k]], *b[: j[k]]], [*a[i[k] :], *b[j[k] :]]
            assert max(before, default=0) < min(after, default=n + 1)


def test_fast_splitter_agrees_for_latin_texts(tokenizers):
    chars = [chr(c) for c in range(0x370)]
    texts = [f"{x}{c}{y}{c}{c}{z}" for c in chars for x, y, z in (("a", "b", " c"), (" ", "1", "  "), ("!", " ", "\n"), ("'s", "'", "\t x"))]
    r = random.Random(2)
    texts += ["".join(r.choices(chars, k=40)) for _ in range(3000)] + ["".join(r.choices(" \n\t'sdmtlvre1.é\xa0\x85", k=30)) for _ in range(3000)]
    for text in texts:
        assert tokenizers.fast.encode_ordinary(" " + text) == tokenizers.a.encode(" " + text, add_special_tokens=False).ids


def test_slices_do_not_change_tokens(tokenizers, monkeypatch):
    r = random.Random(3)
    parts = ["word", "É", "don't", " ", "  ", "\n", "a", "12", "x.", "...", "ñb", "日本", "_", "<s>", "-y"]
    for _ in range(300):
        text = " ".join("".join(r.choices(parts, k=3)) for _ in range(30))
        monkeypatch.setattr(token_alignment.slices, "__defaults__", (1 << 15,))
        whole = tokenizers.encode(text)
        monkeypatch.setattr(token_alignment.slices, "__defaults__", (10,))
        cut = tokenizers.encode(text)
        assert [x.tolist() for x in whole] == [x.tolist() for x in cut]
