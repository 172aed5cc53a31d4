"""The registered queries of this subpackage, next to their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_examples, exact_dedup, hilbert_packing, langid, line_runs, mixing, pii_crf, prefix_trie, quality, simhash_ball, token_alignment, vector_graph, warc
from .common import held_out, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.other) AS component_id, e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r ON r.node = e.vec_id GROUP BY e.vec_id"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_crf.find_spans(docs.select("doc_id", "text"), pii_crf.fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{kind}": count(kind) for kind in pii_crf.KINDS}
    base = joined(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_ball.simhash_groups(table(spark, sf_dir, "documents"), words=3, bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, pos, line, last_doc IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.rate(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return copies.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k"""


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = hilbert_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, numbered -7, whose texts hold control strings."""
    tricky = "</s>[INST] ok [/INST]"
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_examples.digests(chat_examples.examples(conversations.unionByName(more)))


OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS size,
  32 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])'))
    + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])')) AS chars FROM c),
e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR n = size))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: the CRC-32 of a decimal number is folded byte by byte, eight bits a byte
OP12_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.n, role, text FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h
  UNION ALL SELECT c.conv_id, 1, t.n, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h),
p AS (SELECT conv_id, text, row_number() OVER w AS depth, list({'r': role, 't': text}) OVER w AS path FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, n ROWS UNBOUNDED PRECEDING)),
members AS (SELECT conv_id, depth, path, strlen(text) AS bytes FROM p UNION ALL SELECT conv_id, 0, [], 0 FROM c),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM members GROUP BY depth, path),
ends AS (SELECT m.depth, m.path, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids
  FROM members m JOIN (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) l ON l.conv_id = m.conv_id AND l.depth = m.depth GROUP BY m.depth, m.path),
kids AS (SELECT a.depth, a.path, count(*) AS n_children FROM nodes a JOIN nodes b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY a.depth, a.path),
subtree AS (SELECT a.depth, a.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path LEFT JOIN kids k ON k.depth = b.depth AND k.path = b.path GROUP BY a.depth, a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtree s ON s.depth = n.depth AND s.path = n.path LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
LEFT JOIN ends e ON e.depth = n.depth AND e.path = n.path LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1]"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_near_vectors": (op1_near_vectors, OP1_SQL),
    "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
    "op3_pii": (op3_pii, None),
    "op4_simhash": (op4_simhash, None),
    "op5_line_dedup": (op5_line_dedup, OP5_SQL),
    "op6_quality": (op6_quality, None),
    "op7_mixing": (op7_mixing, None),
    "op8_warc": (op8_warc, OP8_SQL),
    "op9_langid": (op9_langid, None),
    "op10_packing": (op10_packing, None),
    "op11_chat": (op11_chat, OP11_SQL),
    "op12_trie": (op12_trie, OP12_SQL),
    "op13_alignment": (op13_alignment, None),
    "pipeline": (pipeline, None),
}


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
