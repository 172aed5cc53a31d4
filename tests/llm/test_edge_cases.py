"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from hyperlake.llm import exact_dedup, hilbert_packing, langid, line_runs, mixing, pii_crf, quality, queries, simhash_ball, vector_graph, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "é\n" + "x" * 50_000
TEXTS = [
    (1, "the same text", "en", "a"), (2, "the same text", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, "  \t\n ", "de", None), (6, LONG, "en", "a"), (None, "the same text", None, "a"),
    (7, "Das ist ein Text über Sprache und Wörter", "de", "b"), (7, "Das ist ein Text über Sprache und Wörter", "de", "b"), (8, "mail me@ex-am.ple.com or +1 (632) 555-4827", "en", "c"), (9, "!!! 123", "en", "c"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(d, t, g, s, len(t) if t else None) for d, t, g, s in TEXTS], DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    for n in names:
        df = df.selectExpr("*", f"'x' as `{n}`")
    return df


# --- exact -------------------------------------------------------------------


def test_exact_groups(docs):
    rows = exact_dedup.exact_groups(clashing(docs, "digest", "kept", "keep_id", "_keep", "_size")).collect()
    assert len(rows) == len(TEXTS)
    same = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"the same text").hexdigest()]
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in same) == [(-1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]
    nothing = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in nothing) == [(3, 4, False), (4, 4, True)]
    assert [r["kept"] for r in rows if r["doc_id"] == 7] == [True, True]


def test_exact_empty_table_and_drop(docs, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_exact(clashing(docs, "_kept_id")).collect()
    assert sorted(r["doc_id"] for r in left) == [2, 4, 5, 6, 7, 7, 8, 9]


def test_misra_gries_finds_every_frequent_digest(spark):
    rows = spark.range(4000).selectExpr("case when id % 3 = 0 then 'hot' when id % 10 = 1 then 'warm' else cast(id as string) end as digest").repartition(7)
    found = {r["digest"] for r in exact_dedup.frequent(rows, counters=32).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 32
    docs = rows.selectExpr("monotonically_increasing_id() as doc_id", "digest as text")
    sizes = {r["text_sha256"]: r["group_size"] for r in exact_dedup.exact_groups(docs, counters=32).collect()}
    assert sizes[hashlib.sha256(b"hot").hexdigest()] == 1334


# --- lines -------------------------------------------------------------------


def test_lines(spark, empty):
    line, other = "A line that is quite long and shared by all of them", "each document has its own line here, number "
    rows = [(k, f"{other}{k}\n \t{line.upper() if k % 2 else line}\r\n{line}", "x") for k in range(6)] + [(10, None, "x"), (11, "", "x"), (12, "\n\n", "x"), (None, line, "x")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, n_lines string"), "_drops", "_doc", "h1")
    for batches, fan_in in ((1, 2), (4, 2), (3, 5)):
        out = {r["doc_id"]: r for r in line_runs.dedup_lines(docs, batches=batches, fan_in=fan_in).collect()}
        assert len(out) == 10
        for k in range(5):
            assert (out[k]["n_lines"], out[k]["n_dropped"], out[k]["text"]) == (3, 2, f"{other}{k}")
        assert out[5]["n_dropped"] == 0 and out[5]["text"].count("\n") == 2
        assert (out[10]["n_lines"], out[10]["text"]) == (1, None) and out[11]["n_lines"] == 1 and out[12]["n_lines"] == 3
        assert (out[None]["n_dropped"], out[None]["text"]) == (1, "")
    assert line_runs.dedup_lines(empty).count() == 0


def test_line_runs_have_no_python_and_no_shuffle_of_runs(spark, docs):
    runs = line_runs.LineRuns(spark, 2, fan_in=3)
    lines = spark.range(50).selectExpr("id % 7 as h1", "id % 7 as h2", "id as doc_id")
    for k in range(4):
        runs.add(lines.filter(f"doc_id % 4 = {k}"))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {r["h1"] for r in runs.frequent().collect()} == set(range(7))
    plan = line_runs.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- simhash -----------------------------------------------------------------


def brute_fingerprint(text, words):
    import xxhash

    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    rows = simhash_ball.fingerprints(clashing(docs, "fp")).collect()
    assert sorted((r["doc_id"] or -1, r["fp"] % 2**64) for r in rows) == sorted((d or -1, brute_fingerprint(t, 3)) for d, t, *_ in TEXTS)


def test_ball_links_agree_with_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, size=40)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(4):
            v = b
            for bit in rng.integers(64, size=rng.integers(1, 5)):
                v ^= 1 << int(bit)
            fps.add((v + 2**63) % 2**64 - 2**63)
    fps = sorted(fps)
    links = simhash_ball.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
    root = {r["node"]: r["root"] for r in simhash_ball.components(links).collect()}
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) % 2**64).count("1") <= 2:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert {f: root.get(f, f) for f in fps} == {f: top(f) for f in fps}


def test_simhash_groups(docs, empty):
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash_ball.simhash_groups(docs).collect())
    assert got == [(-1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (7, 7), (8, 8), (9, 9)]
    assert simhash_ball.simhash_groups(empty).count() == 0
    assert simhash_ball.similar_groups(empty).count() == 0
    left = simhash_ball.drop_near(clashing(docs, "_gone_doc", "fp", "first_doc"))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 6, 7, 7, 8, 9]


def test_similar_groups_link_only_similar_texts(spark):
    rng = np.random.default_rng(0)
    words = np.array([f"w{k}" for k in range(3000)])
    rows, near = [], []
    for k in range(30):
        text = rng.choice(words, size=200)
        copy = text.copy()
        copy[rng.integers(200)] = "changed"
        far = text.copy()
        far[rng.choice(200, size=25, replace=False)] = "altered"
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(copy)), (10 * k + 2, " ".join(far))]
        near.append(10 * k + 1)
    got = {r["doc_id"]: r["component_id"] for r in simhash_ball.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == d for d in got if d % 10 != 1)
    assert sum(got[d] == d - 1 for d in near) >= 27


# --- personal data -----------------------------------------------------------


def test_base_spans_against_plain_patterns():
    plain = {
        0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), 1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        2: re.compile(r"[0-9]([\x20-]?[0-9])+"), 3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }
    digits = lambda s: re.sub("[^0-9]", "", s)
    rng = np.random.default_rng(1)
    alphabet = list("ab@@..019 -+()%_é\n25")
    texts = ["".join(rng.choice(alphabet, size=60)) for _ in range(3000)]
    texts += ["a@b.c@d.e", "x@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (632) 555-4827", "@.a", "a" * 300 + "@b.c", "😀 me@x.yz"]
    for t in texts:
        want = []
        for k, p in plain.items():
            for m in p.finditer(t):
                s = m.group()
                if k == 1 and any(int(x) > 255 for x in s.split(".")) or k == 2 and not (12 <= len(digits(s)) <= 19 and pii_crf.luhn(digits(s))) or k == 3 and not 9 <= len(digits(s)) <= 15:
                    continue
                want.append((m.start(), k, m.end()))
        assert pii_crf.base_spans(t) == sorted(want), t


def test_pattern_search_is_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "+1" + " " * 200_000, "1." * 100_000):
        pii_crf.base_spans(t)


def test_field_finds_what_patterns_miss(spark, docs, empty):
    rng = np.random.default_rng(2)
    words = "the of and retion hanth lyer ondat".split()
    key = lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), size=15)) + "7"
    texts = []
    for k in range(160):
        some = list(rng.choice(words, size=12))
        some.insert(5, [key(), f"mail{k}@host.com", f"12.{k}.7.9", f"in version 2.{k % 10}."][k % 4])
        texts.append((k, " ".join(some)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    field = pii_crf.fit(table)
    out = {r["doc_id"]: r for r in pii_crf.find_spans(clashing(table, "spans"), field).collect()}
    assert all(any(s["kind"] == "crf_secret" for s in out[k]["spans"]) for k in range(0, 160, 4))
    assert not any(out[k]["spans"] for k in range(3, 160, 4))
    assert {s["kind"] for k in range(1, 160, 4) for s in out[k]["spans"]} == {"email"}
    rows = pii_crf.find_spans(docs, field).collect()
    assert all(r["spans"] == [] for r in rows if not r["text"])
    assert [s["kind"] for r in rows if r["doc_id"] == 8 for s in r["spans"]] == ["email", "phone"]
    assert pii_crf.find_spans(empty, pii_crf.fit(empty)).count() == 0
    assert [r["text"] for r in pii_crf.redact(docs, None).collect() if r["doc_id"] == 8] == ["mail [email] or [phone]"]


def test_decoding_is_the_best_segmentation():
    """Against every segmentation of short zones."""
    text = "call a1 b2 now c3"
    (atoms,) = pii_crf.zones(text)
    rng = np.random.default_rng(3)
    cands = pii_crf.segments(text, atoms)
    for _ in range(5):
        field = pii_crf.SpanField(rng.standard_normal((5, pii_crf.BUCKETS)) / 3, rng.standard_normal((6, 6)))

        def score(path):
            total, before, at = 0.0, 0, 0
            for i, j, y in path:
                for _ in range(i - at):
                    total, before = total + field.steps[before, 0], 0
                total += field.steps[before, y] + field.weights[y - 1, dict(cands[j - 1])[j - i]].sum()
                before, at = y, j
            for _ in range(len(cands) - at):
                total, before = total + field.steps[before, 0], 0
            return total

        def every(at):
            if at == len(cands):
                yield ()
                return
            yield from every(at + 1)
            for j in range(at + 1, len(cands) + 1):
                if (j - at) in dict(cands[j - 1]):
                    for y in range(1, 6):
                        for rest in every(j):
                            yield ((at, j, y), *rest)

        assert score(pii_crf.decode(field, cands)) == pytest.approx(max(map(score, every(0))))


# --- classifiers -------------------------------------------------------------


def test_language(docs, empty):
    model = langid.fit(docs)
    rows = langid.identify(clashing(docs, "lang_pred", "_scored"), model).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("en", "de") and 0 <= r["score"] <= 1
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    import duckdb

    want = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = queries.op9_langid(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.97


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 1, 1), (8, 0, 1), (9, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.rate(clashing(docs, "score"), model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.rate(docs, None).collect()} == {0.5}
    assert quality.rate(empty, model).count() == 0


def test_quality_on_held_out_documents(spark):
    import duckdb

    want = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [r for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and want.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.9


# --- mixing ------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    full = set()
    while True:
        open_ = [n for n in names if n not in full]
        share = (sum(sizes.values()) - sum(cap * sizes[n] for n in full)) / sum(w[n] for n in open_)
        more = {n for n in open_ if cap * sizes[n] < share * w[n]}
        if not more:
            return {n: min(cap * sizes[n], share * w[n]) for n in names}
        full |= more


def test_mixing(spark, docs, empty):
    rows = mixing.mix_copies(clashing(docs, "size", "copies", "rate")).collect()
    assert len(rows) == len(TEXTS)
    sizes = {}
    for _, t, _, s in TEXTS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3 for r in rows)
    assert mixing.mix_copies(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(clashing(docs, "_mix_doc", "_own_size"))
    assert mixed.columns[:5] == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "w " * int(min(2000, rng.lognormal(4, 1.5)) + 1), "abcdefgh"[int(rng.integers(8)) if k % 3 else 0]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = mixing.mix_copies(docs).collect(), mixing.mix_copies(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    taken, target, expected = {}, {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        expected[r["source"]] = expected.get(r["source"], 0) + r["rate"] * r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert expected[s] == pytest.approx(target[s], rel=1e-8)
        assert abs(taken[s] - target[s]) < 0.01 * target[s]


# --- warc --------------------------------------------------------------------


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    big = "<p>ü</p>\r\n\r\nWARC/1.1\r\n" * 100
    pages = [(1, "http://a/ b\n", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "y" * 2_000_000), (2, "http://b", big)]
    table = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"), "_body", "_keeper")
    path = str(tmp_path / "archive")
    warc.write_warc(table, path, compression=compression)
    rows = warc.read_warc(spark, path).collect()
    page = lambda v: int(v[9:]) if v and v[9:] else None
    got = sorted((str(page(r["record_id"])), r["record_type"], page(r["refers_to"]), bytes(r["payload"]), r["target_uri"]) for r in rows)
    text = lambda s: s.encode()
    assert got == sorted([
        ("1", "revisit", 2, b"", "http://a/%20b%0A"), ("2", "response", None, text(big), "http://b"), ("2", "response", None, text(big), "http://b"), ("3", "response", None, b"small", None),
        ("4", "response", None, b"small", "u"), ("5", "response", None, b"", "u"), ("6", "response", None, b"", "u"), ("None", "response", None, text(big), "u"), ("7", "response", None, b"y" * 2_000_000, "u"),
    ])
    assert all(r["payload_digest"] == "sha1:" + hashlib.sha1(bytes(r["payload"])).hexdigest() for r in rows if r["record_type"] == "response")
    revisits = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit' and record_id like 'urn:page:%' and content_length > 0")
    assert [(r["payload_length"], r["payload"]) for r in revisits.collect()] == [(len(big.encode()), None)]


def test_warc_pushes_predicates_and_plans_files(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat('z', 500) as html").repartition(8), path, compression="none")
    reader = warc.WarcReader({"path": path, "partition_bytes": "12000"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("content_length",), 3)]))
    assert len(left) == 1 and reader.wanted == [("record_type", "in", ("response",))]
    parts = reader.partitions()
    files = [f for p in parts for f in p.value]
    assert len(files) == len(set(files)) == len([f for f in os.listdir(path) if f.startswith("part-")]) and 1 < len(parts) < len(files)
    reader.wanted = [("record_id", "in", ("urn:page:3",))]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# --- packing -----------------------------------------------------------------


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    odd = [(20, "a\x1cb \x85c d é <|endoftext|> ΑΣ Σ it's"), (21, "don't  STOP now")]
    table = clashing(docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")), "row", "ids", "tokens", "key")
    pieces = hilbert_packing.pack(table, path, length=512).collect()
    want = sorted((str(d), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in [*[r[:2] for r in TEXTS], *odd])
    by_sequence, got = {}, []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        at = by_sequence.get(p["sequence_id"], 0)
        assert p["offset"] == at and len(p["ids"]) == 4 * p["length"]
        by_sequence[p["sequence_id"]] = at + p["length"]
        ids = tuple(np.frombuffer(bytes(p["ids"]), dtype="<u4").tolist())
        if p["start"] == 0:
            got.append([p["doc_id"], ids])
        else:
            assert got[-1][0] == p["doc_id"] and len(got[-1][1]) == p["start"]
            got[-1][1] += ids
    assert sorted((str(d), i) for d, i in got) == want
    assert [n for s, n in sorted(by_sequence.items())][:-1] == [512] * (len(by_sequence) - 1)
    assert hilbert_packing.pack(empty, path).count() == 0


def test_hilbert_neighbours_touch():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert_packing.hilbert(points, 3))
    assert sorted(hilbert_packing.hilbert(points, 3)) == list(range(512))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


# --- vectors -----------------------------------------------------------------


def brute_links(rows):
    ok = {k: np.array(v, dtype=np.float64) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and rows[k][0] is not None}
    links = {k: [j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] / np.linalg.norm(ok[j]) / np.linalg.norm(ok[k]) >= 0.95] if k in ok else [] for k in range(len(rows))}
    return links


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    rows = []
    for k in range(240):
        noise = 0.05 if k % 2 else 0.9
        rows.append((k, [float(x) for x in (base[k % 60] + noise * rng.standard_normal(16)).astype(np.float32)]))
    rows += [(300 + k, rows[1][1]) for k in range(5)] + [(400, [0.0] * 16), (401, None), (402, []), (403, [float("nan")] * 16), (404, [None, 1.0]), (405, [1.0, 1.0]), (406, [2.0, 2.0]), (None, rows[1][1])]
    table = spark.createDataFrame([(v, e, 0, "x") for v, e in rows], "vec_id long, embedding array<float>, label int, node string")
    links = brute_links(rows)
    small = vector_graph.GraphOptions(rows_per_cluster=40, rows_per_shard=25, candidates=12, far=4, degree=6, sample=200, audit=64)
    for options in (vector_graph.GraphOptions(), small):
        got = {r["vec_id"]: r for r in vector_graph.near_vectors(table, options=options).collect()}
        assert len(got) == len(rows)
        found = sum(got[v]["n_links"] for v, _ in rows)
        assert found == sum(map(len, links.values()))
        for k, (v, _) in enumerate(rows):
            seen, todo = {k}, [k]
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (len(links[k]), low, v == low), v
    assert vector_graph.near_vectors(table.limit(0)).count() == 0
