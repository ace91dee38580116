"""Queries over sections, blocks, rules and reconciliations, and checks that are written on their own.

Rule tables here are short examples of what a user gives; hits are all documents, each a hit of its language's query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import normalise as n
from stratum.operators import reconcile, rules, sections
from stratum.operators.retrieval import kept
from stratum.sources.tables import read


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rows = sections.sections(pages, "page_id", sections.marked_text(F.col("html")), sections.page_title(F.col("html")))
    return rows.select("page_id", "ordinal", "level", "heading", "anchor", F.array_join("section_path", " > ").alias("path"), "text")


def document_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = read(spark, sf_dir, "documents").select("doc_id", n.prose(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.md5(F.col("clean").cast("binary")).alias("clean_md5"), F.length("clean").alias("n_chars"))


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sections.blocks(read(spark, sf_dir, "documents"), "doc_id")
    return parts.select("doc_id", "block", "kind", F.length("text").alias("n_chars"))


DETECTORS = [("long", None, None, None, r"^(\S+ ){12}"), ("of", ["of ", " the "], None, ["zzz"], None), ("both", None, ["in", "re"], None, None)]
EXPANSIONS = [("of", 1, "The origin Source"), ("both", 2, "IN re in"), ("long", 3, "detail")]
RULES = [("no_books", 1, None, "book", ["src1", "src3"], False, 0.5, None), ("long_text", 2, "en", "text", ["the"], False, 1.5, 0.001), ("without", 3, "de", "text", ["der"], True, 0.25, None)]
REBALANCE = [("first_books", 1, "en", ["src5"], 10, True), ("others", 2, "de", ["src2", "src0"], 15, False)]


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(DETECTORS, "intent string, any_of array<string>, all_of array<string>, none_of array<string>, pattern string")
    return rules.intents(_queries(spark, sf_dir), table)


def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intents(spark, sf_dir)


def query_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(EXPANSIONS, "intent string, ordinal int, terms string")
    return rules.expanded(_queries(spark, sf_dir), _intents(spark, sf_dir), table)


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter(F.col("lang").isNotNull())
    hits = docs.select(F.col("lang").alias("query_id"), "doc_id", F.col("source").alias("book"), F.substring_index("text", "\n", 1).alias("section"), "text", (F.lit(1.0) / (F.lit(1) + F.length("text"))).alias("score"))
    asked = hits.select("query_id", F.col("query_id").alias("intent")).distinct()
    table = spark.createDataFrame(RULES, "rule string, ordinal int, intent string, field string, words array<string>, absent boolean, factor double, bonus double")
    return rules.adjusted(hits, asked, table)


def adjusted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir).select("query_id", "doc_id", "score", F.array_join("fired", ",").alias("fired"))


def _first(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    every = kept(_adjusted(spark, sf_dir).select("query_id", "doc_id", "book", "score"), "adjusted")
    return rules.ranked(every, 20), every, every.select("query_id", F.col("query_id").alias("intent")).distinct()


def rebalanced_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, every, asked = _first(spark, sf_dir)
    table = spark.createDataFrame(REBALANCE, "rule string, ordinal int, intent string, books array<string>, reach int, rescue boolean")
    return rules.rebalanced(first, every, asked, table, 10).select("query_id", "rank", "doc_id", "book", "rule")


def chosen_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, _, asked = _first(spark, sf_dir)
    shapes = asked.select("query_id", F.lit(5).alias("limit"), F.lit(0.5).alias("cutoff"), F.lit(2).alias("per_book"), F.lit(0.72).alias("near"))
    families = spark.createDataFrame([("en", "src0", "add", 0.6), ("de", "src1", "lock", None), ("de", "src2", "lock", None)], "query_id string, book string, mode string, factor double")
    return rules.contexts(first, shapes, families).select("query_id", "place", "doc_id", "book")


def title_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug by slug, what four tables call a market segment's or a nation's book."""
    customer, nation, supplier, orders = (read(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "orders"))
    slug = lambda c: F.concat(F.lit("b"), c.cast("string"))
    sources = {
        "manifest": nation.select(slug(F.col("n_nationkey")).alias("slug"), F.initcap("n_name").alias("title")),
        "registry": nation.select(slug(F.col("n_nationkey") + 3).alias("slug"), F.col("n_name").alias("title")),
        "sections": supplier.groupBy("s_nationkey").agg(F.max("s_name").alias("title")).select(slug(F.col("s_nationkey")).alias("slug"), "title"),
        "chunks": customer.groupBy("c_nationkey").agg(F.min("c_mktsegment").alias("title")).select(slug(F.col("c_nationkey") * 2).alias("slug"), "title"),
    }
    told = reconcile.aligned(sources, "slug", "title")
    return told.select("slug", F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("titles"), F.array_join("missing", ",").alias("missing"), "conflict")


def corpus_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    row = reconcile.corpus_counters(docs, "doc_id", "text", ["text", "lang", "source"], {"vectors": vectors, "labels": read(spark, sf_dir, "labels")})
    told = reconcile.checked(row, {"ids_are_unique": F.col("repeated_ids") == 0, "no_empty_text": F.col("blank_text") == 0, "vectors_are_whole": F.col("not_in_vectors") == 0})
    return told.withColumn("failed", F.array_join("failed", ","))


def reader_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reader_grade(read(spark, sf_dir, "documents"), "source", "text")


def language_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reconcile.histogram(read(spark, sf_dir, "documents"), "source", "lang", "langs")
    return told.select("source", F.array_join(F.transform(F.map_entries("langs"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("langs"))


def citation_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are citations of their suppliers; its text cites them by part."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("cited"))
    by_part = F.array_sort(F.transform("cited", lambda x, i: F.struct(x["l_partkey"].alias("part"), (i + 1).alias("number"))))
    answer = F.array_join(F.transform(by_part, lambda x: F.concat(F.lit("part "), x["part"].cast("string"), F.lit(" ["), x["number"].cast("string"), F.lit("]"))), " ")
    done = lines.select("l_orderkey", n.renumbered(answer, F.transform("cited", lambda x: x["l_suppkey"] % 3)).alias("done"))
    return done.select("l_orderkey", F.col("done.text").alias("answer"), F.array_join(F.transform("done.kept", lambda x: x.cast("string")), ",").alias("kept"))


def turn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", n.rewritten(F.col("text"), ("conversation", F.col("conv_id").cast("string"))).alias("query"), F.size(n.sub_queries(F.col("text"))).alias("n_queries"), F.md5(n.excerpt(F.col("text"), n.SHORT_EXCERPT).cast("binary")).alias("excerpt_md5"), n.section_core(F.col("text")).alias("core"))


# checks: SQL of their own

_SPACED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _paragraphs(x: str) -> str:
    """A cleaned paragraph as a list of short ones."""
    parts = rf"list_filter(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: s <> '')"
    element = "{'done': []::VARCHAR[], 'open': s, 'n': 1, 'size': length(s) + 1}"
    step = "CASE WHEN a.size + length(b.open) > 200 OR a.n >= 2 THEN {'done': list_append(a.done, a.open), 'open': b.open, 'n': 1, 'size': b.size} ELSE {'done': a.done, 'open': a.open || ' ' || b.open, 'n': a.n + 1, 'size': a.size + b.size} END"
    folded = f"list_reduce(list_transform({parts}, lambda s: {element}), lambda a, b: {step})"
    return f"CASE WHEN length({x}) < 210 OR len({parts}) < 2 THEN [{x}] ELSE list_append(({folded}).done, ({folded}).open) END"


def _prose(rows: str, id: str, text: str) -> str:
    """id, clean: each text as short paragraphs, in the order of its blocks."""
    return rf"""
plain AS (SELECT {id}, regexp_replace(replace(regexp_replace(coalesce({text}, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+', ' ', 'g') AS x FROM {rows}),
cut AS (SELECT {id}, string_split_regex(x, '\n\s*\n+') AS xs FROM plain),
each AS (SELECT {id}, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM cut),
tidy AS (SELECT {id}, i, regexp_replace(regexp_replace(trim(regexp_replace(x, '\s*\n\s*', ' ', 'g')), '\s+([,.:;!?%)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g') AS x FROM each WHERE regexp_matches(x, '\S')),
short AS (SELECT {id}, i, {_paragraphs('y')} AS ps FROM (SELECT {id}, i, {_SPACED.format('x')} AS y FROM tidy)),
clean AS (SELECT p.{id}, coalesce(string_agg(array_to_string(ps, chr(10) || chr(10)), chr(10) || chr(10) ORDER BY i), '') AS clean FROM plain p LEFT JOIN short s ON p.{id} = s.{id} GROUP BY p.{id})"""


_ENTITIES = "x"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_name}', '{_char}')"
_HITS = """
hits AS (SELECT lang AS query_id, doc_id, source AS book, text, 1e0 / (1 + length(text)) AS score FROM documents WHERE lang IS NOT NULL),
fired AS (SELECT *, contains(lower(coalesce(book, '')), 'src1') OR contains(lower(coalesce(book, '')), 'src3') AS f1, query_id = 'en' AND contains(lower(coalesce(text, '')), 'the') AS f2, query_id = 'de' AND NOT contains(lower(coalesce(text, '')), 'der') AS f3 FROM hits),
adjusted AS (SELECT query_id, doc_id, book, round(score * CASE WHEN f1 THEN 0.5e0 ELSE 1e0 END * CASE WHEN f2 THEN 1.5e0 ELSE 1e0 END * CASE WHEN f3 THEN 0.25e0 ELSE 1e0 END + CASE WHEN f2 THEN 0.001e0 ELSE 0e0 END, 8) AS score,
  concat_ws(',', CASE WHEN f1 THEN 'no_books' END, CASE WHEN f2 THEN 'long_text' END, CASE WHEN f3 THEN 'without' END) AS fired FROM fired),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book NULLS FIRST, doc_id) AS rank FROM adjusted)"""
_INTENTS = r"""
q AS (SELECT item_id AS query_id, text AS query, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS s FROM benchmark),
asked AS (SELECT query_id, 'long' AS intent FROM q WHERE regexp_matches(s, '^(\S+ ){12}') UNION ALL SELECT query_id, 'of' FROM q WHERE (contains(s, 'of ') OR contains(s, ' the ')) AND NOT contains(s, 'zzz') UNION ALL SELECT query_id, 'both' FROM q WHERE contains(s, 'in') AND contains(s, 're'))"""

QUERIES = {f.__name__: f for f in (page_sections, document_prose, document_blocks, query_intents, query_expanded, adjusted_hits, rebalanced_by_rules, chosen_contexts, title_alignment, corpus_validation, reader_grades, language_histograms, citation_renumbering, turn_queries)}
ORACLES = {
    # every page has one article, one heading and paragraphs
    "page_sections": rf"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS root FROM pages),
b AS (SELECT page_id, {_SPACED.format(_ENTITIES.replace('(x,', "(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'),", 1))} AS heading,
  {_ENTITIES.replace('(x,', "(regexp_replace(regexp_replace(regexp_replace(regexp_replace(root, '(?s)<h1[^>]*>.*?</h1>', chr(10) || chr(10), 'g'), '<br */?>', chr(10), 'g'), '</?(p|ul|ol|li|div)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'),", 1)} AS body FROM a), {_prose('b', 'page_id', 'body')}
SELECT b.page_id, 1::INT AS ordinal, 1::INT AS level, heading, 'overview' AS anchor, heading AS path, clean AS text FROM b JOIN clean USING (page_id) WHERE clean <> ''""",
    "document_prose": f"WITH {_prose('documents', 'doc_id', 'text')} SELECT doc_id, md5(clean) AS clean_md5, length(clean)::INT AS n_chars FROM clean",
    "document_blocks": r"""WITH cut AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS xs FROM documents),
each AS (SELECT doc_id, generate_subscripts(xs, 1) AS block, unnest(xs) AS x FROM cut),
told AS (SELECT *, regexp_matches(x, '(?is)^(주의|경고|중요|참고|팁|warning|caution|important|note|tip)\s*[:：]\s*.+$') AS note, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: regexp_matches(l, '\S')) AS ls FROM each)
SELECT doc_id, block::INT AS block, CASE WHEN note THEN 'note' WHEN starts_with(x, 'Prerequisites') AND length(x) > 14 THEN 'prerequisite' WHEN regexp_matches(ls[1], '^\d+\.\s+\S') AND len(list_filter(ls, lambda l: NOT regexp_matches(l, '^(\d+\.|[-*])\s+\S'))) = 0 THEN 'procedure' ELSE 'paragraph' END AS kind,
  length(CASE WHEN note THEN trim(regexp_replace(x, '^[^:：]*[:：]\s*', '')) ELSE x END)::INT AS n_chars FROM told""",
    "query_intents": f"WITH {_INTENTS} SELECT query_id, intent FROM asked",
    "query_expanded": rf"""WITH {_INTENTS}, terms(intent, ordinal, terms) AS (VALUES ('of', 1, 'The origin Source'), ('both', 2, 'IN re in'), ('long', 3, 'detail')),
own AS (SELECT query_id, string_agg(terms, ' ' ORDER BY ordinal) AS more FROM asked JOIN terms USING (intent) GROUP BY query_id),
words AS (SELECT query_id, list_filter(string_split_regex(concat_ws(' ', query, coalesce(more, '')), '\s+'), lambda w: w <> '') AS ws FROM q LEFT JOIN own USING (query_id)),
low AS (SELECT *, list_transform(ws, lambda w: lower(w)) AS ls FROM words)
SELECT query_id, array_to_string(list_filter(ws, lambda w, i: list_position(ls, lower(w)) = i), ' ') AS query FROM low""",
    "adjusted_hits": f"WITH {_HITS} SELECT query_id, doc_id, score, fired FROM adjusted",
    "rebalanced_by_rules": f"""WITH {_HITS}, reached AS (
  SELECT query_id, doc_id, book, CASE WHEN rank <= 20 THEN rank ELSE 1000000000 + rank END AS pos, CASE query_id WHEN 'en' THEN 'first_books' ELSE 'others' END AS rule FROM ranked
  WHERE query_id = 'en' AND book = 'src5' AND (rank <= 10 OR rank > 20) OR query_id = 'de' AND book IN ('src2', 'src0') AND rank <= 15
), best AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) = 1),
placed AS (SELECT query_id, 0 AS pos, doc_id, book FROM best UNION ALL SELECT query_id, rank, doc_id, book FROM ranked r WHERE rank <= 20 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = r.query_id AND b.doc_id = r.doc_id))
SELECT p.query_id, (row_number() OVER (PARTITION BY p.query_id ORDER BY p.pos))::INT AS rank, p.doc_id, p.book, b.rule FROM placed p LEFT JOIN best b USING (query_id) QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY p.pos) <= 10""",
    "chosen_contexts": f"""WITH {_HITS}, w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, max(score) OVER (PARTITION BY query_id, book) AS mine, count(*) OVER (PARTITION BY query_id, book) AS n, first_value(book) OVER (PARTITION BY query_id ORDER BY rank) AS lead FROM ranked WHERE rank <= 10),
locks AS (SELECT query_id, bool_or(query_id = 'de' AND book IN ('src1', 'src2') AND mine > 0) AS locked FROM w GROUP BY query_id),
ok AS (SELECT w.* FROM w JOIN locks USING (query_id) WHERE score >= 0.5e0 * top AND coalesce(CASE WHEN locked THEN book IN ('src1', 'src2') ELSE book = lead OR (query_id = 'en' AND book = 'src0' AND mine >= 0.6e0 * top) OR (n >= 2 AND mine >= 0.72e0 * top) END, false)),
few AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY query_id, book ORDER BY rank) <= 2)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS place, doc_id, book FROM few QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""",
    "title_alignment": """WITH m AS (SELECT 'b' || n_nationkey AS slug, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t FROM nation), r AS (SELECT 'b' || (n_nationkey + 3) AS slug, n_name AS t FROM nation),
s AS (SELECT 'b' || s_nationkey AS slug, max(s_name) AS t FROM supplier GROUP BY s_nationkey), c AS (SELECT 'b' || (c_nationkey * 2) AS slug, min(c_mktsegment) AS t FROM customer GROUP BY c_nationkey),
j AS (SELECT slug, m.t AS m, r.t AS r, s.t AS s, c.t AS c FROM m FULL JOIN r USING (slug) FULL JOIN s USING (slug) FULL JOIN c USING (slug))
SELECT slug, concat_ws(';', 'chunks=' || c, 'manifest=' || m, 'registry=' || r, 'sections=' || s) AS titles, concat_ws(',', CASE WHEN m IS NULL THEN 'manifest' END, CASE WHEN r IS NULL THEN 'registry' END, CASE WHEN s IS NULL THEN 'sections' END, CASE WHEN c IS NULL THEN 'chunks' END) AS missing,
  len(list_distinct(list_filter([lower(m), lower(r), lower(s), lower(c)], lambda x: x IS NOT NULL))) > 1 AS conflict FROM j""",
    "corpus_validation": r"""WITH c AS (SELECT count(*) AS n_rows, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\S')) AS blank_text, count(*) FILTER (NOT regexp_matches(coalesce(lang, ''), '\S')) AS blank_lang, count(*) FILTER (NOT regexp_matches(coalesce(source, ''), '\S')) AS blank_source,
  count(doc_id) - count(DISTINCT doc_id) AS repeated_ids, count(text) - count(DISTINCT text) AS repeated_texts FROM documents),
x AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS not_in_vectors, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS only_in_vectors,
  (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS not_in_labels, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_in_labels)
SELECT *, repeated_ids = 0 AS ids_are_unique, blank_text = 0 AS no_empty_text, not_in_vectors = 0 AS vectors_are_whole, concat_ws(',', CASE WHEN repeated_ids > 0 THEN 'ids_are_unique' END, CASE WHEN blank_text > 0 THEN 'no_empty_text' END, CASE WHEN not_in_vectors > 0 THEN 'vectors_are_whole' END) AS failed, repeated_ids = 0 AND blank_text = 0 AND not_in_vectors = 0 AS ok FROM c, x""",
    "reader_grades": "SELECT source, count(*) AS n_sections, count(*) FILTER (length(text) > 1200) AS n_long, count(*) FILTER (length(text) > 1200 AND NOT contains(text, chr(10) || chr(10))) AS n_flat, max(length(coalesce(text, '')))::INT AS longest, CASE WHEN count(*) FILTER (length(text) > 1200 AND NOT contains(text, chr(10) || chr(10))) = 0 THEN 'good' WHEN count(*) FILTER (length(text) > 1200 AND NOT contains(text, chr(10) || chr(10))) < 0.1e0 * count(*) THEN 'fair' ELSE 'poor' END AS grade FROM documents GROUP BY source",
    "language_histograms": "SELECT source, string_agg(lang || ':' || n, ',' ORDER BY lang) AS langs FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY source",
    # all marks are known; a supplier's number is its place among first uses
    "citation_renumbering": """WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey % 3 AS who, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS pos FROM r),
f AS (SELECT l_orderkey, who, min(pos) AS first, arg_min(l_linenumber, pos) AS line FROM l GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS num FROM f),
a AS (SELECT l.l_orderkey, string_agg('part ' || l_partkey || ' [' || num || ']', ' ' ORDER BY pos) AS answer FROM l JOIN g USING (l_orderkey, who) GROUP BY ALL), k AS (SELECT l_orderkey, string_agg(line::VARCHAR, ',' ORDER BY num) AS kept FROM g GROUP BY ALL)
SELECT l_orderkey, answer, kept FROM a JOIN k USING (l_orderkey)""",
    "turn_queries": rf"""WITH t AS (SELECT conv_id, turn, text, {_SPACED.format("coalesce(text, '')")} AS s FROM conversations WHERE role = 'user'),
p AS (SELECT *, list_filter(list_transform(string_split_regex(s, '[?？]'), lambda x: trim(x)), lambda x: contains(x, ' ')) AS qs FROM t),
c AS (SELECT *, list_filter(list_transform(flatten(list_transform(qs, lambda q: string_split_regex(q, '\s(그리고|and then|and also)\s'))), lambda x: trim(x)), lambda x: contains(x, ' ')) AS cs FROM p)
SELECT conv_id, turn, s || ' | conversation ' || conv_id AS query, len(list_distinct(list_filter(list_transform(list_concat([s], CASE WHEN len(qs) > 1 OR len(cs) > len(qs) THEN list_concat(qs, cs) ELSE [] END), lambda x: lower(x)), lambda x: x <> '')))::INT AS n_queries, md5(s[:240]) AS excerpt_md5,
  regexp_replace(lower(s), '^\d+(\.\d+)*\.?\s*', '') AS core FROM c""",
}
