"""Searches of several sub-queries over a core corpus and an overlay, and bounded searches of whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.text import tokens
from stratum.operators import retrieval as r
from stratum.operators import search as s
from stratum.sources.tables import read

from .retrieval import ORACLES as RETRIEVAL
from .retrieval import QUERY_EVERY, TOKENS_SQL

NOISE = "doc_id % 7 = 3"
#: Drafts are the sources; every second query selects one of so many.
DRAFTS = 20


def bm25_bounded_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each item, by bounds of blocks: the rows of bm25_batch_all."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).cast("long").alias("sub"), tokens(F.col("text")).alias("terms"))
    return s.search(s.index(read(spark, sf_dir, "documents"), items), items, 10).drop("sub")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]")))
    return parts.select(F.col("item_id").alias("query_id"), F.col("pos").cast("long").alias("sub"), tokens(F.col("col")).alias("terms"))


def _sentence_hits(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    sentences = _sentences(spark, sf_dir)
    hits = s.search(s.index(docs, sentences), sentences, 20)
    return hits.join(docs.select("doc_id", F.col("source").alias("book")), "doc_id")


def multi_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's sentences are sub-queries; English documents are the core, those of other languages are uploads, of which every second query selects one source."""
    docs = read(spark, sf_dir, "documents")
    contexts = read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 2 == 0).alias("restricted"), F.array(F.concat(F.lit("src"), F.col("item_id") % DRAFTS)).alias("selected")
    )
    uploads = _sentence_hits(spark, sf_dir, docs.filter("lang <> 'en'"))
    uploads = s.of_selection(uploads.withColumn("draft", F.col("book")), contexts)
    # ranks in an upload list count what the selection leaves
    kept = uploads.drop("draft").withColumn("rank", F.row_number().over(s.Window.partitionBy("query_id", "sub").orderBy("rank")))
    return s.multi_search(_sentence_hits(spark, sf_dir, docs.filter("lang = 'en'")), kept, 20, noise=F.expr(NOISE))


def multi_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors ask together; vectors of the labels 8 and 9 are private ones."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % QUERY_EVERY < 3).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    books = vectors.select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("label"), "label").alias("book"))

    def hits(of: str) -> DataFrame:
        found = r.cosine_top_blocks(vectors.filter(of), asked, 20).join(books, "doc_id")
        return found.withColumn("sub", F.col("query_id") % QUERY_EVERY).withColumn("query_id", F.col("query_id") - F.col("sub"))

    return s.multi_vector_search(hits("label < 8"), hits("label >= 8"), 20, noise=F.expr(NOISE))


def _scored(name: str, where: str) -> str:
    return f"""
{name}_toks AS (SELECT doc_id, source AS book, coalesce({TOKENS_SQL.format('text')}, []) AS ts FROM documents WHERE {where}),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM {name}_toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_totals AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean FROM {name}_toks),
{name}_scored AS (
  SELECT query_id, sub, doc_id, book, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / greatest(mean, 1.0)))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_toks USING (doc_id) JOIN asked USING (term), {name}_totals GROUP BY ALL
), {name}_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY score DESC, doc_id) AS rank FROM {name}_scored WHERE score > 0 QUALIFY rank <= 20)"""


def _merged(name: str, hits: str, keys: str) -> str:
    return f"""
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, book NULLS FIRST, doc_id) AS rank FROM (
  SELECT {keys}, doc_id, book, round(sum(w / (60 + rank)), 8) AS score FROM ({hits}) WHERE NOT doc_id % 7 = 3 GROUP BY ALL) QUALIFY rank <= 20)"""


_MULTI = f"""
WITH asked AS (
  SELECT DISTINCT item_id AS query_id, sub, unnest({TOKENS_SQL.format('sentence')}) AS term
  FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS sentence, generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) - 1 AS sub FROM benchmark)
), {_scored('core', "lang = 'en'")}, {_scored('upload', "lang <> 'en'")},
selected AS (SELECT query_id, sub, doc_id, book, row_number() OVER (PARTITION BY query_id, sub ORDER BY rank) AS rank FROM upload_hits WHERE query_id % 2 <> 0 OR book = 'src' || (query_id % {DRAFTS})),
{_merged('core', 'SELECT *, 1.0::DOUBLE AS w FROM core_hits', 'query_id')},
{_merged('overlay', 'SELECT *, 1.0::DOUBLE AS w FROM selected', 'query_id')},
{_merged('both_lists', 'SELECT *, 1.0::DOUBLE AS w FROM core WHERE query_id IN (SELECT query_id FROM overlay) UNION ALL SELECT *, 1.35::DOUBLE FROM overlay', 'query_id')}
SELECT query_id, doc_id, book, score, rank FROM both_lists UNION ALL SELECT query_id, doc_id, book, score, rank FROM core WHERE query_id NOT IN (SELECT query_id FROM overlay)
"""
_VECTORS = f"""
WITH qv AS (SELECT vec_id - vec_id % {QUERY_EVERY} AS query_id, vec_id % {QUERY_EVERY} AS sub, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {QUERY_EVERY} < 3),
near AS (SELECT query_id, sub, label >= 8 AS private, vec_id AS doc_id, 'label' || label AS book, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, qv),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub, private ORDER BY score DESC, doc_id) AS rank FROM near WHERE score > 0 QUALIFY rank <= 20),
several AS (SELECT query_id, sub FROM hits GROUP BY ALL HAVING count(DISTINCT private) = 2),
{_merged('named', 'SELECT hits.*, CASE WHEN private THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS w FROM hits JOIN several USING (query_id, sub)', 'query_id, sub')},
lists AS (SELECT query_id, doc_id, book, rank FROM named UNION ALL SELECT query_id, doc_id, book, rank FROM hits ANTI JOIN several USING (query_id, sub)),
{_merged('merged', 'SELECT *, 1.0::DOUBLE AS w FROM lists', 'query_id')}
SELECT query_id, doc_id, book, score, rank FROM merged
"""

QUERIES = {f.__name__: f for f in (bm25_bounded_all, multi_query_search, multi_query_vectors)}
ORACLES = {"bm25_bounded_all": RETRIEVAL["bm25_batch_all"], "multi_query_search": _MULTI, "multi_query_vectors": _VECTORS}
