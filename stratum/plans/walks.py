"""Walks of any depth over trees that the documents make: topics, and texts that include texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import trees
from stratum.sources.tables import read

#: Children of a document in a tree of topics, and documents that include each other.
FAN, GROUP = 4, 100

#: In each of seven trees the k-th node hangs below the node k div FAN.
_PARENT = f"CASE WHEN doc_id < 7 THEN NULL ELSE doc_id % 7 + 7 * CAST(floor(floor(doc_id / 7.0) / {FAN}.0) AS BIGINT) END"
_NODES = f"""
SELECT doc_id % 7 AS tree, doc_id AS node, {_PARENT} AS parent, n_chars AS pos, CASE WHEN doc_id % 5 <> 0 THEN concat('Topic ', doc_id) END AS name,
  CASE WHEN doc_id < 7 THEN concat(' /', source, '/ ') WHEN doc_id % 11 = 0 THEN concat(lang, '/') END AS dir,
  CASE WHEN doc_id % 2 = 0 THEN concat('F-', doc_id % 50) WHEN doc_id % 9 = 0 THEN concat('/G.', doc_id % 90, '.adoc') END AS file,
  CASE WHEN lang = 'fr' THEN 'fr' WHEN lang = 'de' THEN 'en , de' ELSE '' END AS filter
FROM DOCUMENTS
"""


def topic_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that English readers may see, with the directory and the filter of all above them; a source's files stand in its own folder, or in one of a language."""
    docs = read(spark, sf_dir, "documents")
    nodes = spark.sql(_NODES.replace("DOCUMENTS", "{docs}"), docs=docs)
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("F-"), (F.col("doc_id") % 50).cast("string"))).otherwise(F.concat(F.lit("G."), (F.col("doc_id") % 90).cast("string")))
    files = docs.select(F.concat_ws("/", "source", F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.concat(name, F.lit(".adoc"))).alias("path"))
    out = trees.topic_entries(nodes, files, "en")
    return out.select("tree", "ordinal", "node", "slug", "title", "path", F.concat_ws(" > ", "topic_path").alias("topic_path"), F.concat_ws(" > ", "family").alias("family"))


def include_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document includes two others of its hundred, the one that includes it, and one that isn't there; a hundred's first is a root."""
    docs = read(spark, sf_dir, "documents")
    own, at = F.floor(F.col("doc_id") / GROUP) * GROUP, F.col("doc_id") % GROUP
    path = lambda n: F.concat(F.lit("p"), (n % 3).cast("string"), F.lit("/d"), n.cast("string"), F.lit(".adoc"))
    include = lambda n, there: F.when(there, F.concat(F.lit("\ninclude::../"), path(own + n), F.lit("[]"))).otherwise("")
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " ")
    parent = F.floor((at - 1) / 2).cast("long")
    text = F.concat(F.lit(":lang: "), "lang", F.lit("\nin {lang}\nt"), words, F.lit("x"), include(2 * at + 1, 2 * at + 1 < GROUP), F.lit("\nthen {lang}"), include(2 * at + 2, 2 * at + 2 < GROUP), include(parent, at > 0), F.lit("\ninclude::gone.adoc[]\nlast {lang}"))
    files = docs.select(path(F.col("doc_id")).alias("path"), text.alias("text"), at.alias("at"))
    out = trees.expanded(files.select("path", "text"), files.filter("at = 0").select("path"))
    return out.select("root", "n_files", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.sha2("text", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (topic_walk, include_expansion)}
ORACLES = {
    "topic_walk": f"""
WITH RECURSIVE nodes AS ({_NODES.replace('DOCUMENTS', 'documents')}),
steps AS (SELECT *, {{'pos': pos, 'node': node::VARCHAR}} AS step, regexp_replace(trim(coalesce(dir, '')), '^/+|/+$', '', 'g') AS folder FROM nodes),
walk AS (
  SELECT tree, node, [step] AS place, [name] AS names, folder AS dirs, file FROM steps WHERE parent IS NULL AND folder <> '' AND (filter = '' OR filter LIKE '%en%')
  UNION ALL
  SELECT w.tree, s.node, list_append(w.place, s.step), list_append(w.names, s.name), CASE WHEN s.folder = '' THEN w.dirs ELSE w.dirs || '/' || s.folder END, s.file
  FROM walk w JOIN steps s ON s.parent = w.node AND s.tree = w.tree WHERE s.filter = '' OR s.filter LIKE '%en%'
), files AS (
  SELECT DISTINCT source || '/' || CASE WHEN doc_id % 3 = 0 THEN lang || '/' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'F-' || (doc_id % 50) ELSE 'G.' || (doc_id % 90) END || '.adoc' AS path FROM documents
), placed AS (
  SELECT *, dirs || '/' || CASE WHEN file LIKE '/%' THEN file[2:] ELSE file || '.adoc' END AS path FROM walk WHERE len(place) > 1 AND file IS NOT NULL
), firsts AS (SELECT * FROM placed SEMI JOIN files USING (path) QUALIFY row_number() OVER (PARTITION BY tree, path ORDER BY place) = 1)
SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY place) AS ordinal, node,
  trim(regexp_replace(lower(replace(path[:-6], '/', '__')), '[^a-z0-9_]+', '_', 'g'), '_') AS slug, coalesce(names[-1], regexp_extract(path[:-6], '[^/]+$')) AS title, path,
  array_to_string(list_filter(names[2:], lambda n: n IS NOT NULL), ' > ') AS topic_path, coalesce(names[1], '') AS family
FROM firsts
""",
    "include_expansion": f"""
WITH RECURSIVE walk AS (
  SELECT doc_id AS root, doc_id AS node, []::BIGINT[] AS place FROM documents WHERE doc_id % {GROUP} = 0
  UNION ALL
  SELECT w.root, d.doc_id, list_append(w.place, 2 * k + 1) FROM walk w, (SELECT unnest([0, 1]) AS k) ks JOIN documents d ON d.doc_id = w.root + 2 * (w.node % {GROUP}) + k + 1 AND 2 * (w.node % {GROUP}) + k + 1 < {GROUP}
), parts AS (
  SELECT root, list_append(place, kind) AS place, kind, lang, text FROM walk JOIN documents ON doc_id = node, (SELECT unnest([0, 2, 4]) AS kind) ks
), told AS (
  SELECT *, last_value(CASE WHEN kind = 0 THEN lang END IGNORE NULLS) OVER (PARTITION BY root ORDER BY place) AS known FROM parts
), shown AS (
  SELECT root, place, CASE kind WHEN 0 THEN 'in ' || known || chr(10) || 't' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g') || 'x' WHEN 2 THEN 'then ' || known ELSE 'last ' || known END AS line, kind FROM told
)
SELECT 'p' || (root % 3) || '/d' || root || '.adoc' AS root, count(*) FILTER (kind = 0) AS n_files, (count(*) + count(*) FILTER (kind = 0))::BIGINT AS n_lines, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest
FROM shown GROUP BY shown.root
""",
}
