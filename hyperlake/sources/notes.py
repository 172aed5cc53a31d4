"""Front-matter notes, wiki links, degraded edges and claim notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: note layout and link form
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)\z"
WIKI_LINK = r"\[\[([^\]]+)\]\]"
HREF = r'href="([^"]+)"'


def links(text: Column, pattern: str = WIKI_LINK) -> Column:
    """Captured link targets, repeated ones once, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _scalar(meta: Column, key: str) -> Column:
    got = F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*([^\n]*?)[ \t]*$", 1)
    return F.when(meta.rlike(rf"(?m)^{key}:"), F.regexp_replace(got, "^['\"]|['\"]$", ""))


def _list(meta: Column, key: str) -> Column:
    """Inline ``[a, b]`` or block ``- a`` lists; empty where the key is absent."""
    inline = F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    block = F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*- [^\n]*(?:\n|\z))+)", 1)
    items = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*- ([^\n]*?)[ \t]*$"), F.lit(1)))
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return F.filter(clean, lambda x: x != "")


def parse_notes(files: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """Concept rows; ``problem`` marks notes without front matter or concept id."""
    t = F.col(text)
    meta, body = F.regexp_extract(t, FRONT_MATTER, 1), F.regexp_extract(t, FRONT_MATTER, 2)
    ok = t.rlike(FRONT_MATTER)
    concept = _scalar(meta, "concept_id")
    return files.select(
        path, F.when(ok, concept).alias("concept_id"), _list(meta, "excludes").alias("excludes"),
        F.coalesce(F.lower(_scalar(meta, "requires_fidelity")).isin("true", "yes", "on"), F.lit(False)).alias("requires_fidelity"),
        _list(meta, "degraded_fidelity_edges").alias("degraded_fidelity_edges"), F.when(ok, links(body)).alias("wikilinks"), F.when(ok, body).alias("body"),
        F.when(~ok, "no_front_matter").when(concept.isNull(), "no_concept_id").alias("problem"),
    )


def scan_notes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return parse_notes(files)


def duplicate_concepts(notes: DataFrame) -> DataFrame:
    return notes.filter("concept_id IS NOT NULL").groupBy("concept_id").agg(F.count(F.lit(1)).alias("notes")).filter("notes > 1")


def degraded_edges(notes: DataFrame) -> DataFrame:
    """Distinct union of all degraded edges."""
    return notes.select(F.explode("degraded_fidelity_edges").alias("edge_name")).distinct()


def admissible(tasks: DataFrame, notes: DataFrame) -> DataFrame:
    """Add ``admissible``: null with problem ``unknown_kind`` where no concept names the task kind.

    ``tasks``: task_kind, edge_name, outage.  Both note-derived sides have one row
    per concept or edge; AQE picks the join.
    """
    c = notes.filter("concept_id IS NOT NULL").select(F.col("concept_id").alias("task_kind"), "requires_fidelity", F.array_contains("excludes", "outage").alias("_ex"), F.lit(True).alias("_known"))
    d = degraded_edges(notes).withColumn("_bad", F.lit(True))
    j = tasks.join(c, "task_kind", "left").join(d, "edge_name", "left")
    bad = F.coalesce("_bad", F.lit(False))
    ok = ~(bad & (F.col("requires_fidelity") | (F.col("outage") & F.col("_ex"))))
    return j.select(*tasks.columns, F.when(F.col("_known"), ok).alias("admissible"), F.when(F.col("_known").isNull(), "unknown_kind").alias("problem"))


def claim_notes(claims: DataFrame) -> DataFrame:
    """Note text for withheld claims: one row per claim with its status."""
    s = F.col("scenario").cast("string")
    ident = F.concat_ws("-", F.lit("claim"), s, "status")
    text = F.concat(
        F.lit("---\nconcept_id: "), ident, F.lit("\nclaim_status: "), F.col("status"), F.lit("\nscenario: "), s,
        F.lit("\nexcludes: []\nrequires_fidelity: false\n---\n\n# Withheld / scored claim\n\n"), F.col("reason"), F.lit("\n"),
    )
    return claims.select(ident.alias("concept_id"), "status", text.alias("value"))


def write_claim_notes(claims: DataFrame, path: str) -> None:
    """One folder of notes for each status; a rerun replaces the folders of the statuses it writes and leaves the others."""
    notes = claim_notes(claims).select("status", "value")
    notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status").text(path)
