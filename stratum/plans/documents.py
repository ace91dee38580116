"""Queries over texts, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import text as t
from stratum.operators import chunks, pages, upserts
from stratum.sources.tables import read
from stratum.streaming import events


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(read(spark, sf_dir, "documents"))


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.titles(read(spark, sf_dir, "pages"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(read(spark, sf_dir, "pages"))


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", t.token_count(F.col("text")).cast("long").alias("n_tokens"), F.length(t.collapse_spaces(F.col("text"))).cast("long").alias("n_collapsed"))


def section_prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    path = F.concat_ws(" > ", "p_brand", F.concat((F.col("p_size") % 9).cast("string"), F.lit(".2. "), "p_name"))
    return parts.select("p_partkey", t.strip_section_prefix(path).alias("section"), t.slugify(F.col("p_name")).alias("slug"))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    unit = lambda *units: F.element_at(F.array(*[F.lit(u) for u in units]), (F.col("p_partkey") % len(units) + 1).cast("int"))
    size = F.col("p_size").cast("string")
    cpu, memory = F.concat(size, unit("m", "u", "n", "")), F.concat(size, unit("Ki", "Mi", "Gi", "Ti", ""))
    return parts.select("p_partkey", F.round(t.cpu_millicores(cpu), 9).alias("millicores"), F.round(t.memory_mib(memory), 9).alias("mib"))


def name_based_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", t.uuid5(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("chunk_id"))


def snapshot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    new = docs.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang")).alias("lang"), "source", (F.col("n_chars") + F.coalesce("quality", F.lit(0))).alias("n_chars"))
    diff = upserts.snapshot_diff(docs, new, ["doc_id"], ["lang", "source", "n_chars"])
    return diff.select("doc_id", "change", F.concat_ws(",", "fields").alias("fields"))


def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.missing_counts(read(spark, sf_dir, "documents"), ["text", "lang", "source"])


def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.session_contexts(read(spark, sf_dir, "conversations"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.windows(read(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (chunk_pack, html_titles, html_links, token_stats, section_prefix_strip, quantities, name_based_ids, snapshot_fields, missing_values, session_context, event_windows)}
ORACLES = {
    "html_titles": "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs FROM pages",
    "html_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages), f AS (SELECT page_id, href, min(i) AS i FROM l GROUP BY ALL) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position, href FROM f""",
    "token_stats": r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_tokens, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_collapsed FROM documents",
    "section_prefix_strip": "SELECT p_partkey, p_name AS section, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part",
    "quantities": "SELECT p_partkey, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1e-3 WHEN 2 THEN 1e-6 ELSE 1000 END, 9) AS millicores, round(p_size * CASE p_partkey % 5 WHEN 0 THEN 1 / 1024e0 WHEN 1 THEN 1 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 ELSE 1 / 1048576e0 END, 9) AS mib FROM part",
    "snapshot_fields": "WITH b AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang, n_chars + coalesce(quality, 0) AS n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT d.doc_id, CASE WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN b.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN d.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN d.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END) END AS fields FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id WHERE b.doc_id IS NULL OR d.lang IS DISTINCT FROM b.lang OR d.n_chars IS DISTINCT FROM b.n_chars",
    "missing_values": "SELECT count(*) AS n_rows, count(*) FILTER (coalesce(trim(text), '') = '' OR coalesce(trim(lang), '') = '' OR coalesce(trim(source), '') = '') AS rows_missing_any, count(*) FILTER (coalesce(trim(text), '') = '') AS missing_text, count(*) FILTER (coalesce(trim(lang), '') = '') AS missing_lang, count(*) FILTER (coalesce(trim(source), '') = '') AS missing_source FROM documents",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
