"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame with the columns of
``documents``; the last one returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperlake.llm import hilbert_packing, langid, line_runs, mixing, queries, simhash_ball
from hyperlake.llm.common import fresh, shared_dir, table

#: bytes of an Arrow batch: a few hundred documents at a time are enough for Python workers, and take little memory
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get batches of a few MB, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification (operator 9), learned from the documents' own labels: documents that it rejects go.

    Null, empty and letterless texts are rejected; rows that repeat are judged alike.  An empty table stays empty.
    """
    small_batches(spark)
    names = fresh(docs, "_lang_pred", "_lang_score", "_lang_rejected")
    found = langid.identify(docs, langid.fit(docs), names=tuple(names))
    return found.filter(~F.col(names[2])).select(*docs.columns)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 5): a line of many documents stays in the last of them; ``n_chars`` follows the text.

    Null and empty texts have one empty line, which stays.  An empty table stays empty.
    """
    lines, dropped = fresh(docs, "_n_lines", "_n_dropped")
    return line_runs.dedup_lines(docs, n_lines=lines, n_dropped=dropped).withColumn("n_chars", line_runs.n_chars("text")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup of five-word shingles at 0.8: of every group the document with the smallest id stays.

    Balls of SimHashes (operator 4) link first, each link verified; as they reach 2 of 64 bits only, a join on prefixes
    of the shingle sets finds all other pairs of this similarity.  Texts without words are alike.  An empty table stays
    empty.
    """
    small_batches(spark)
    return simhash_ball.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (operator 7): every document as many times as its source's target asks for.

    A null source is a source of its own; texts without words change no sum and stay.  An empty table stays empty.
    """
    small_batches(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 10): pieces of token sequences, with their ids; every row is a document of its own."""
    small_batches(spark)
    return hilbert_packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_frequent_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus; every stage's result is written as Parquet in the shared folder and read again."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
