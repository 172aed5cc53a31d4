"""Every pipeline stage against brute force on its own input, and the stages' contract."""

import re

import duckdb
import pytest

import corpus_pipeline
from hyperlake.llm import mixing, queries
from hyperlake.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, by name."""
    top, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(top / name))
        out[name] = (docs, spark.read.parquet(str(top / name)))
        docs = out[name][1]
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_contract(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]
    for name, (_, out) in stages.items():
        assert out.columns[:5] == COLUMNS if name != "packing" else "ids" in out.columns


def test_language_stage_keeps_whole_rows(stages):
    before, after = map(rows, stages["language_id"])
    kept = {r["doc_id"] for r in after}
    assert all(r in before for r in after)
    assert {r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or "")}.isdisjoint(kept)
    assert len(kept) >= 0.97 * len(before)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    want = {r[0]: r[1:] for r in con.execute(queries.OP5_SQL).fetchall()}
    import hashlib

    for r in rows(after):
        assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"])
    assert len(rows(after)) == len(want)


def test_simhash_stage(stages):
    before, after = map(rows, stages["simhash_dedup"])
    kept = {r["doc_id"] for r in after}
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    similar = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    # whatever went is similar to a document with a smaller id, or to one that is
    for d in sets.keys() - kept:
        assert any(e != d and similar(d, e) for e in sets), d
    alone = [d for d in sets if not any(e != d and similar(d, e) for e in sets)]
    assert set(alone) <= kept
    texts = [r["text"] for r in after]
    assert len(texts) == len(set(texts))
    assert all(r in before for r in after)


def test_mixing_stage(spark, stages):
    before, after = stages["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_copies(before).collect()}
    got = {}
    for r in rows(after):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: c for d, c in copies.items() if c}


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows(before))
    pieces = rows(after)
    assert sum(r["length"] for r in pieces) == want
    ends = {}
    for r in pieces:
        ends[r["sequence_id"]] = ends.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 4096 for s, n in ends.items() if s != max(ends))


def test_words_are_counted_alike(spark):
    texts = ["a b\tc\n\nd", "", None, " é ü ", "x" * 10_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(df["t"])).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


KIND = "doc_id long, text string, lang string, source string, n_chars long, _lang_pred string, _n_lines string, _gone_doc string, _copies string, row string"
NEAR = " ".join(f"word{k}" for k in range(60))


def odd_documents(spark):
    line = "a line that many of the documents of this table have in common"
    given = [
        (1, NEAR, "en", "a"), (2, NEAR + " more", "en", "a"), (3, NEAR + " more", "en", "b"), (None, None, None, None), (4, None, "en", None), (5, "", "en", "a"), (6, " \n", None, "a"),
        (7, "twice " + NEAR[::-1], "en", "b"), (7, "twice " + NEAR[::-1], "en", "b"), (8, "very long " * 30_000, "en", "c"), *[(20 + k, f"{line}\nthe words of document number {k} are its own", "en", "a") for k in range(8)],
    ]
    return spark.createDataFrame([(*g, len(g[1] or ""), *["x"] * 5) for g in given], KIND)


def run_stages(spark, docs, top):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(top / name))
        docs = out[name] = spark.read.parquet(str(top / name))
    return out


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = odd_documents(spark)
    out = run_stages(spark, docs, tmp_path)
    for name, df in out.items():
        if name != "packing":
            assert df.columns == docs.columns
            assert {tuple(r)[5:] for r in df.collect()} == {("x",) * 5}, name
    lines = {r["doc_id"]: r["text"] for r in out["line_dedup"].collect()}
    # documents without a letter went; the common line stays in the last document only
    assert set(lines) == {1, 2, 3, 7, 8, *range(20, 28)} and [d for d in range(20, 28) if "in common" in lines[d]] == [27]
    kept = [r["doc_id"] for r in out["simhash_dedup"].collect()]
    # near copies go, all rows of the document that stays do not
    assert {2, 3}.isdisjoint(kept) and sorted(d for d in kept if d < 10) == [1, 7, 7, 8]


def test_stages_on_an_empty_table(spark, tmp_path):
    out = run_stages(spark, odd_documents(spark).limit(0), tmp_path)
    assert [df.count() for df in out.values()] == [0] * 5
