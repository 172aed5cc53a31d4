"""The packing operator's token ids against the tokenizer on whole texts."""

import json
import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from hyperlake.llm import hilbert_packing, queries


@pytest.fixture(scope="module")
def both():
    path = queries.tokenizer_path()
    return hilbert_packing.Encoder(path), Tokenizer.from_file(path), path


def ids(data):
    import numpy as np

    return np.frombuffer(data, dtype="<u4").tolist()


def agree(both, text):
    assert ids(both[0].encode(text)) == both[1].encode(text, add_special_tokens=False).ids, text[:200]


def test_merger_is_used_for_this_vocabulary(both):
    assert both[0].fast is not None


def test_every_latin_character_in_context(both):
    for c in map(chr, range(1, 0x300)):
        for text in (f"a{c}b", f"{c} {c}{c}", f"1{c}'s{c}", f"x {c}. y", f"{c}ll '{c}"):
            agree(both, text)


def test_random_texts(both):
    r = random.Random(8)
    latin = [chr(c) for c in range(1, 0x300)]
    pieces = ["word", "Wörter", "it's", "don'T", "'ll", "<|endoftext|>", "<|x", "ΑΣ", "Σ", "日本", "é", "\x1c", "\x85", "\xa0", "12", "3.5%", "...", "!?", "\n", "\t", "  ", "ﬁ", "İ", "ß", "😀", "''", "$^2"]
    for _ in range(1500):
        agree(both, "".join(r.choices(latin, k=30)))
        agree(both, " ".join("".join(r.choices(pieces, k=r.randrange(1, 4))) for _ in range(12)))
        agree(both, "".join(r.choices("abcdefghijklmnopqrstuvwxyzé .,'", k=60)))


def test_long_texts_are_cut_at_blanks(both, monkeypatch):
    text = "some Words, über 12 <|endoftext|> " * 500 + "x" * 300
    monkeypatch.setattr(hilbert_packing, "SLICE", 17)
    agree(both, text)


def test_every_token_is_reached_by_its_own_merge(both):
    """What makes ids usable as ranks: merging a token's own bytes in order ends with that token's pair."""
    model = json.load(open(both[2], encoding="utf-8"))["model"]
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    rank = {m: i for i, m in enumerate(merges)}
    assert [model["vocab"]["".join(m)] for m in merges] == sorted(model["vocab"]["".join(m)] for m in merges) and len({"".join(m) for m in merges}) == len(merges)
    for left, right in merges:
        token = left + right
        signs = [*token.removesuffix("</w>")]
        if token.endswith("</w>"):
            signs[-1] += "</w>"
        while len(signs) > 2:
            best = min(range(len(signs) - 1), key=lambda k: rank.get((signs[k], signs[k + 1]), len(rank)))
            assert (signs[best], signs[best + 1]) in rank
            signs[best : best + 2] = [signs[best] + signs[best + 1]]
        assert tuple(signs) == (left, right)


def test_classes_are_those_of_unicode():
    assert "é" in hilbert_packing.LETTERS and "²" in hilbert_packing.NUMBERS and unicodedata.category("²") == "No"
