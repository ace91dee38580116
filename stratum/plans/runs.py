"""Whole retrievals: the benchmark's items as questions, words and vectors as lists, a row of trace for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import retrieval as r
from stratum.operators import retrieve as rt
from stratum.operators import search as s
from stratum.sources.tables import read

from .retrieval import QUERY_EVERY, TOKENS_SQL
from .searches import _merged, _scored

#: Questions of this ending are out of the corpus; such as begin with this follow up on another.
_ENDS, _FOLLOWS = "thing.", "^(?:re|of) "


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th item asks together with the n-th stated vector; items whose text has 'tionand' get more candidates."""
    items = read(spark, sf_dir, "benchmark").select((F.col("item_id") * QUERY_EVERY).alias("query_id"), F.regexp_replace("text", r"\. ", "? ").alias("query"), F.concat(F.lit("hint "), F.col("item_id").cast("string")).alias("hint"))
    text = F.lower("query")
    asked = items.select("query_id", F.explode(F.array_compact(F.array(F.when(text.endswith(_ENDS), "out"), F.when(text.contains("tionand"), "wide")))).alias("intent"))
    return r.kept(rt.plan(items, asked, ["wide"], ["out"], _FOLLOWS), "plans")


def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's plan says."""
    return _plans(spark, sf_dir).select("query_id", F.col("rewritten").alias("rewritten"), F.size("parts").alias("n_parts"), "follow_up", F.col("candidates").cast("int").alias("candidates"), "outside")


def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions from plan to final hits."""
    docs, vectors = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    plans = _plans(spark, sf_dir)
    books = docs.select("doc_id", F.col("source").alias("book"))
    parts = rt.part_queries(plans)
    hits = s.search(s.index(docs, parts), parts, rt.WIDE).join(books, "doc_id")
    words = r.kept(rt.within_budget(s.multi_search(rt.within_budget(hits, plans), None, rt.WIDE), plans), "words")
    asked = vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(plans.select("query_id"), "query_id", "left_semi")
    near = r.kept(rt.within_budget(r.cosine_top_blocks(vectors, asked, rt.WIDE), plans).join(books, "doc_id"), "near")
    final = r.kept(rt.diverse(rt.fused({"words": (words, 100), "vector": (near, 115)})), "final")
    out = rt.traced(plans, {"words": words, "vector": near}, final)
    joined = [F.array_join(c, " ").alias(c) for c in ("words_books", "vector_books", "final_books", "overlap")]
    return out.select("query_id", "n_parts", "outside", F.col("n_words").cast("long"), F.col("n_vector").cast("long"), F.col("n_final").cast("long"), *joined, "support")


QUERIES = {f.__name__: f for f in (retrieval_plan, retrieval_trace)}
_PLANS = rf"""
items AS (SELECT item_id * {QUERY_EVERY} AS query_id, item_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\. ', '? ', 'g'), '\s+', ' ', 'g')) AS q FROM benchmark),
cut AS (SELECT *, list_filter(list_transform(string_split_regex(q, '[?？]'), lambda x: trim(x)), lambda x: contains(x, ' ')) AS qs, regexp_matches(lower(q), '{_FOLLOWS}') AS follow_up FROM items),
clauses AS (SELECT *, list_filter(list_transform(flatten(list_transform(qs, lambda x: string_split_regex(x, '\s(그리고|and then|and also)\s'))), lambda x: trim(x)), lambda x: contains(x, ' ')) AS cs FROM cut),
said AS (SELECT *, CASE WHEN follow_up THEN q || ' hint ' || item_id ELSE q END AS rewritten, list_concat([q], CASE WHEN len(qs) > 1 OR len(cs) > len(qs) THEN list_concat(qs, cs) ELSE [] END) AS listed FROM clauses),
once AS (SELECT *, list_filter(listed, lambda x, i: x <> '' AND list_position(list_transform(listed, lambda y: lower(y)), lower(x)) = i) AS held FROM said),
plans AS (
  SELECT query_id, rewritten, follow_up, q, CASE WHEN rewritten <> q AND NOT list_contains(held, rewritten) THEN list_append(held, rewritten) ELSE held END AS parts, CASE WHEN lower(q) LIKE '%{_ENDS}' THEN 'out' END AS outside FROM once
), budgets AS (SELECT *, CASE WHEN len(parts) > 1 OR follow_up OR contains(lower(q), 'tionand') THEN {rt.WIDE} ELSE {rt.CANDIDATES} END AS candidates FROM plans)"""
ORACLES = {
    "retrieval_plan": f"WITH {_PLANS} SELECT query_id, rewritten, len(parts)::INT AS n_parts, follow_up, candidates::INT AS candidates, outside FROM budgets",
    "retrieval_trace": f"""
WITH {_PLANS}, asked AS (SELECT DISTINCT query_id, sub, unnest({TOKENS_SQL.format('part')}) AS term FROM (SELECT query_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sub FROM budgets WHERE outside IS NULL)),
{_scored('doc', 'true').replace('rank <= 20', f'rank <= {rt.WIDE}')},
within AS (SELECT h.* FROM doc_hits h JOIN budgets USING (query_id) WHERE rank <= candidates),
{_merged('merged', 'SELECT *, 1.0::DOUBLE AS w FROM within', 'query_id').replace('WHERE NOT doc_id % 7 = 3', '').replace('rank <= 20', f'rank <= {rt.WIDE}')},
words AS (SELECT m.query_id, doc_id, book, rank FROM merged m JOIN budgets USING (query_id) WHERE rank <= candidates),
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {QUERY_EVERY} = 0 AND vec_id IN (SELECT query_id FROM budgets WHERE outside IS NULL)),
near AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, qv),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near WHERE score > 0),
vector AS (SELECT r.query_id, doc_id, source AS book, rank FROM ranked r JOIN budgets USING (query_id) JOIN documents USING (doc_id) WHERE rank <= candidates),
each AS (SELECT *, 'words' AS origin, floor(100000000 / (60 + rank))::BIGINT AS part FROM words UNION ALL SELECT *, 'vector', floor(115000000 / (60 + rank))::BIGINT FROM vector),
support AS (SELECT query_id, book, count(DISTINCT origin) AS n FROM each WHERE rank <= 10 GROUP BY ALL),
summed AS (SELECT query_id, doc_id, book, sum(part) AS points, string_agg(DISTINCT origin, '+' ORDER BY origin) AS origins FROM each GROUP BY ALL),
fused AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY points * CASE WHEN n > 1 THEN 11 ELSE 10 END DESC, book NULLS FIRST, doc_id) AS rank FROM summed f LEFT JOIN support USING (query_id, book)),
capped AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, book ORDER BY rank) <= 2),
final AS (SELECT query_id, doc_id, book, origins, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM capped QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8),
lists AS (SELECT query_id, book, rank, 'words' AS name FROM words UNION ALL SELECT query_id, book, rank, 'vector' FROM vector UNION ALL SELECT query_id, book, rank, 'final' FROM final),
tops AS (SELECT query_id, name, book, min(rank) AS at_ FROM lists WHERE rank <= 5 GROUP BY ALL),
shown AS (SELECT query_id, name, list(book ORDER BY at_) AS books FROM tops GROUP BY ALL),
counts AS (SELECT query_id, name, count(*) AS n FROM lists GROUP BY ALL)
SELECT b.query_id, len(b.parts)::INT AS n_parts, b.outside, coalesce(cw.n, 0)::BIGINT AS n_words, coalesce(cv.n, 0)::BIGINT AS n_vector, coalesce(cf.n, 0)::BIGINT AS n_final,
  coalesce(array_to_string(w.books, ' '), '') AS words_books, coalesce(array_to_string(v.books, ' '), '') AS vector_books, coalesce(array_to_string(f.books, ' '), '') AS final_books,
  coalesce(array_to_string(list_filter(w.books, lambda x: list_contains(v.books, x)), ' '), '') AS overlap, coalesce(t.origins, 'none') AS support
FROM budgets b LEFT JOIN counts cw ON cw.query_id = b.query_id AND cw.name = 'words' LEFT JOIN counts cv ON cv.query_id = b.query_id AND cv.name = 'vector' LEFT JOIN counts cf ON cf.query_id = b.query_id AND cf.name = 'final'
LEFT JOIN shown w ON w.query_id = b.query_id AND w.name = 'words' LEFT JOIN shown v ON v.query_id = b.query_id AND v.name = 'vector' LEFT JOIN shown f ON f.query_id = b.query_id AND f.name = 'final' LEFT JOIN final t ON t.query_id = b.query_id AND t.rank = 1
""",
}
