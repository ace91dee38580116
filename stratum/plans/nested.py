"""Nested books and payloads of any shape, made of the documents and conversations: their texts taken out and put back, their fields dropped, their links found."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import payloads as p
from stratum.operators import units as u
from stratum.sources.tables import read

_BLANK = {"kind": None, "text": None, "caption": None, "title": None, "label": None, "items": None, "steps": None, "headers": None, "cells": None}
_TYPES = {"items": "array<string>", "steps": "array<struct<text string, substeps array<string>>>", "headers": "array<string>", "cells": "array<array<string>>"}


def _block(**of):
    return F.struct(*[of.get(k, F.lit(None)).cast(_TYPES.get(k, "string")).alias(k) for k in _BLANK])


def _capitals(text: Column) -> Column:
    """a-z as A-Z; a text of ASCII alone is raised as a whole."""
    return F.when(F.octet_length(text) == F.length(text), F.upper(text)).otherwise(F.translate(text, ascii_lowercase, ascii_uppercase))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a book: a section for each line, a block for each sentence of it: in turn a paragraph, a note, a list of steps, and a row of cells."""

    def block(s, k):
        words = F.split(s, " ", -1)
        steps = F.transform(F.split(s, ", ", -1), lambda x: F.struct(x.alias("text"), F.array(_capitals(x)).alias("substeps")))
        kinds = [_block(kind=F.lit("paragraph"), text=s), _block(kind=F.lit("note"), title=F.lit("Note"), text=s), _block(kind=F.lit("procedure"), steps=steps), _block(kind=F.lit("table"), headers=F.array(F.lit("A"), F.lit("B")), cells=F.array(words))]
        return F.when(k % 4 == 0, kinds[0]).when(k % 4 == 1, kinds[1]).when(k % 4 == 2, kinds[2]).otherwise(kinds[3])

    sections = F.transform(F.split("text", "\n", -1), lambda line, n: F.struct(F.substring(line, 1, 20).alias("heading"), F.array(F.col("source"), F.col("lang")).alias("path"), F.transform(F.split(line, r"\. ", -1), block).alias("blocks")))
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), sections.alias("sections"))


def translation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document and kind of unit: how many there are, their characters, and the least address."""
    kind = F.regexp_replace("unit_id", r"^s\d+\.(?:b\d+\.)?|\.\d+(?:\.\d+)?(?=\.|$)", "")
    rows = u.units(_books(spark, sf_dir), "doc_id").withColumn("kind", kind)
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.min("unit_id").alias("first_id"))


def translated_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second paragraph, and all titles, in capitals: the books as one text again."""
    books = _books(spark, sf_dir)
    wanted = lambda x: (x == "doc.title") | (x.endswith(".paragraph") & x.rlike(r"b\d*[048]\.paragraph$"))
    given = u.units(books, "doc_id", wanted).select("doc_id", "unit_id", _capitals(F.col("text")).alias("text"))
    done = u.translated(books, given, "doc_id")
    text = lambda b: F.coalesce(b["text"], F.array_join(F.transform(b["steps"], lambda s: s["text"]), ", "), F.array_join(b["cells"][0], " "))
    lines = F.transform("sections", lambda s: F.array_join(F.transform(s["blocks"], text), ". "))
    return done.select("doc_id", "title", F.size("sections").cast("long").alias("n_sections"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a logged payload with a run's paths, its uploads, and each turn's citation."""
    turns = read(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL")
    link = F.concat(F.lit("/packs/u"), (F.col("conv_id") % 7 + F.col("turn")).cast("string"), F.lit("/t"), F.col("turn").cast("string"))
    one = F.struct(F.struct(link.alias("href"), F.lit("tmp").alias("path")).alias("citation"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", one.alias("t")))).alias("all"))
    body = F.struct(
        F.struct(F.col("conv_id").alias("draft_id"), F.lit("/srv/log").alias("path")).alias("audit"), F.lit("/srv/log.json").alias("path"), F.struct(F.lit("m1").alias("model"), F.lit("/x").alias("root_dir")).alias("runtime"),
        F.array(F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string"), F.lit("::v1")), F.lit(" ")).alias("selected_draft_ids"), F.transform("all", lambda a: a["t"]).alias("turns"),
    )
    return own.select(F.col("conv_id").alias("id"), F.parse_json(F.to_json(body)).alias("payload"))


def payload_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which uploads each conversation's payload names, at whatever depth."""
    nodes = p.walk(_payloads(spark, sf_dir))
    return p.linked_ids(nodes, ["draft_id"], ["selected_draft_ids"], [r"^/packs/([^/]+)/"]).select(F.col("id").alias("conv_id"), "found")


def payload_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without the log's path, the run's folder and the citations' paths, put together again."""
    nodes = p.without_fields(p.walk(_payloads(spark, sf_dir)), [("path",), ("audit", "path"), ("runtime", "root_dir"), ("**", "citation", "path")])
    return p.nested(nodes).select(F.col("id").alias("conv_id"), F.length("json").cast("long").alias("n_chars"), F.sha2("json", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (translation_units, translated_books, payload_links, payload_sanitised)}
_CUT = r"""
lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS s FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, s, unnest(string_split(line, '. ')) AS part, generate_subscripts(string_split(line, '. '), 1) - 1 AS b FROM lines)"""
ORACLES = {
    "translation_units": rf"""
WITH {_CUT}, listed AS (
  SELECT doc_id, 'doc.title' AS kind, 'doc.title' AS unit_id, source AS text FROM documents
  UNION ALL SELECT doc_id, 'heading', 's' || s || '.heading', line[:20] FROM lines
  UNION ALL SELECT doc_id, 'path', 's' || s || '.path.0', source FROM lines UNION ALL SELECT doc_id, 'path', 's' || s || '.path.1', lang FROM lines
  UNION ALL SELECT doc_id, 'paragraph', 's' || s || '.b' || b || '.paragraph', part FROM parts WHERE b % 4 = 0
  UNION ALL SELECT doc_id, 'note.title', 's' || s || '.b' || b || '.note.title', 'Note' FROM parts WHERE b % 4 = 1
  UNION ALL SELECT doc_id, 'note.text', 's' || s || '.b' || b || '.note.text', part FROM parts WHERE b % 4 = 1
  UNION ALL SELECT doc_id, 'procedure.text', 's' || s || '.b' || b || '.procedure.' || (generate_subscripts(string_split(part, ', '), 1) - 1) || '.text', unnest(string_split(part, ', ')) FROM parts WHERE b % 4 = 2
  UNION ALL SELECT doc_id, 'procedure.substep', 's' || s || '.b' || b || '.procedure.' || (generate_subscripts(string_split(part, ', '), 1) - 1) || '.substep.0', translate(unnest(string_split(part, ', ')), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM parts WHERE b % 4 = 2
  UNION ALL SELECT doc_id, 'table.header', 's' || s || '.b' || b || '.table.header.' || k, ['A', 'B'][k + 1] FROM parts, (SELECT unnest([0, 1]) AS k) WHERE b % 4 = 3
  UNION ALL SELECT doc_id, 'table.cell', 's' || s || '.b' || b || '.table.cell.0.' || (generate_subscripts(string_split(part, ' '), 1) - 1), unnest(string_split(part, ' ')) FROM parts WHERE b % 4 = 3
), trimmed AS (SELECT doc_id, kind, unit_id, regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS text FROM listed)
SELECT doc_id, kind, count(*) AS n, sum(length(text))::BIGINT AS chars, min(unit_id) AS first_id FROM trimmed WHERE text <> '' GROUP BY ALL
""",
    "translated_books": rf"""
WITH {_CUT}, shown AS (
  SELECT doc_id, s, b, CASE WHEN b % 4 = 0 AND b % 10 IN (0, 4, 8) AND regexp_replace(part, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') <> ''
    THEN translate(regexp_replace(part, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE part END AS part FROM parts
), joined AS (SELECT doc_id, s, string_agg(part, '. ' ORDER BY b) AS line FROM shown GROUP BY ALL),
texts AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY s) AS text FROM joined GROUP BY doc_id)
SELECT d.doc_id, upper(source) AS title, coalesce(n, -1)::BIGINT AS n_sections, sha256(t.text) AS digest FROM documents d LEFT JOIN texts t USING (doc_id)
""",
    "payload_links": """
SELECT DISTINCT conv_id, unnest([conv_id::VARCHAR, 's' || (conv_id % 5), 'u' || (conv_id % 7 + turn)]) AS found FROM conversations WHERE conv_id IS NOT NULL
UNION SELECT conv_id, regexp_extract(trim(text), '^/packs/([^/]+)/', 1) FROM conversations WHERE regexp_matches(trim(text), '^/packs/[^/]+/')
""",
    "payload_sanitised": """
WITH turns AS (
  SELECT conv_id, string_agg(json_object('citation', json_object('href', '/packs/u' || (conv_id % 7 + turn) || '/t' || turn), 'role', role, 'text', coalesce(text, ''), 'turn', turn)::VARCHAR, ',' ORDER BY turn, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), whole AS (
  SELECT conv_id, '{"audit":' || json_object('draft_id', conv_id)::VARCHAR || ',"runtime":{"model":"m1"},"selected_draft_ids":["s' || (conv_id % 5) || '::v1"," "],"turns":[' || t || ']}' AS json FROM turns
)
SELECT conv_id, length(json) AS n_chars, sha256(json) AS digest FROM whole
""",
}
