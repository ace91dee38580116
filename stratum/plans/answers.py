"""Citations behind answers and what users looked at last, over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import answers as a
from stratum.sources.tables import read


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order asks, its lines are citations of parts: a book of 40 each, and a place in it that lines may share."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    met = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return met.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("ordinal"), (F.col("l_partkey") % 40).cast("string").alias("book"), (F.col("l_partkey") % 40 * 10 + F.col("l_suppkey") % 3).cast("string").alias("identity"), F.concat_ws(" ", "p_name", "p_type").alias("text"))


def citations_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.fallback_citations(_citations(spark, sf_dir)).select("query_id", F.col("index").cast("long").alias("index"), "ordinal", "identity")


def citations_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status prefer books, with a second choice; urgent ones prefer others after that."""
    orders = read(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_orderkey").alias("query_id"), F.explode(F.array_compact(F.array(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, "urgent")))).alias("intent"))
    some = lambda *ks: [str(k) for k in range(40) if k % 10 in ks]
    rules = spark.createDataFrame([(1, "F", [some(1, 2), some(1, 2, 3, 4)]), (2, "O", [some(5)]), (3, "urgent", [some(2, 5), some(9)])], "ordinal int, intent string, tiers array<array<string>>")
    return a.pruned_citations(_citations(spark, sf_dir), asked, rules).select("query_id", "ordinal", "book")


def citations_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for a colour by number, and some for what a priority needs."""
    orders = read(spark, sf_dir, "orders")
    query = F.concat(F.lit("show Part  "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" "), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 4 == 0, " please").otherwise(""))
    rules = spark.createDataFrame([("hurry", "urgent|high", "please", ["steel", "BRASS"]), ("low", "low", None, ["copper", "tin"])], "rule string, asks string, unless string, any_of array<string>")
    done = a.grounded(orders.select(F.col("o_orderkey").alias("query_id"), query.alias("query")), _citations(spark, sf_dir), rules, r"part\s+\d+")
    return done.select("query_id", F.array_join("missing", ",").alias("missing"), "grounded")


def recent_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are a user's targets."""
    n = F.col("event_id")
    ref = F.when(F.col("event_type") == "view", F.concat(F.lit("book:b"), (n % 9).cast("string"))).when(F.col("event_type") == "click", F.concat(F.lit("section: b"), (n % 9).cast("string"), F.lit("#x"))).when(F.col("event_type") == "purchase", F.concat(F.lit("figure:b"), (n % 9).cast("string"), F.when(n % 2 == 0, ":a.png").otherwise(""))).when(F.col("event_type") == "signup", F.concat(F.lit("entity:e"), (n % 5).cast("string"))).otherwise("none")
    rows = read(spark, sf_dir, "events").select("user_id", ref.alias("target_ref"), F.col("ts").alias("updated"), F.col("event_id").alias("id"))
    return a.recent_preferences(rows).select("user_id", "kind", "name", F.col("score").cast("long").alias("score"))


QUERIES = {f.__name__: f for f in (citations_fallback, citations_pruned, citations_grounded, recent_targets)}
_CITED = "cited AS (SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS ordinal, (l_partkey % 40)::VARCHAR AS book, (l_partkey % 40 * 10 + l_suppkey % 3)::VARCHAR AS identity, lower(p_name || ' ' || p_type) AS text FROM lineitem JOIN part ON p_partkey = l_partkey)"
ORACLES = {
    "citations_fallback": f"""
WITH {_CITED}, firsts AS (SELECT * FROM cited QUALIFY row_number() OVER (PARTITION BY query_id, identity ORDER BY ordinal, book) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, book, identity) AS index, ordinal, identity FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ordinal, book, identity) <= 3
""",
    "citations_pruned": f"""
WITH {_CITED}, told AS (SELECT c.*, book::INT % 10 AS k, o_orderstatus AS s, o_orderkey % 5 = 0 AS urgent FROM cited c JOIN orders ON o_orderkey = query_id),
one AS (SELECT *, CASE WHEN s = 'F' AND k IN (1, 2) THEN 1 WHEN s = 'F' AND k IN (1, 2, 3, 4) THEN 2 WHEN s = 'O' AND k = 5 THEN 1 ELSE 9 END AS tier FROM told),
kept AS (SELECT * FROM one QUALIFY tier = min(tier) OVER (PARTITION BY query_id)),
two AS (SELECT *, CASE WHEN urgent AND k IN (2, 5) THEN 1 WHEN urgent AND k = 9 THEN 2 ELSE 9 END AS next FROM kept)
SELECT query_id, ordinal, book FROM two QUALIFY next = min(next) OVER (PARTITION BY query_id)
""",
    "citations_grounded": f"""
WITH {_CITED}, texts AS (SELECT query_id, string_agg(text, chr(10)) AS x FROM cited GROUP BY query_id),
told AS (SELECT o_orderkey AS query_id, lower(o_orderpriority) AS p, o_orderkey % 4 = 0 AS please, 'part ' || (o_orderkey % 50) AS command, x FROM orders LEFT JOIN texts ON query_id = o_orderkey),
lacks AS (SELECT *, CASE WHEN x IS NULL THEN 'citation' ELSE concat_ws(',', CASE WHEN NOT contains(x, command) THEN 'command' END, CASE WHEN regexp_matches(p, 'urgent|high') AND NOT please AND NOT regexp_matches(x, 'steel|brass') THEN 'hurry' END, CASE WHEN p LIKE '%low%' AND NOT regexp_matches(x, 'copper|tin') THEN 'low' END) END AS missing FROM told)
SELECT query_id, missing, missing = '' AS grounded FROM lacks
""",
    "recent_targets": """
WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS place FROM events QUALIFY place <= 12),
told AS (
  SELECT user_id, CASE WHEN event_type = 'signup' THEN 'entity' ELSE 'book' END AS kind, CASE WHEN event_type = 'signup' THEN 'e' || (event_id % 5) ELSE 'b' || (event_id % 9) END AS name,
    greatest(10, 80 - 6 * (place - 1)) - CASE event_type WHEN 'click' THEN 8 WHEN 'purchase' THEN 16 ELSE 0 END AS score
  FROM last WHERE event_type IN ('view', 'click', 'signup') OR event_type = 'purchase' AND event_id % 2 = 0)
SELECT user_id, kind, name, max(score)::BIGINT AS score FROM told GROUP BY ALL
""",
}
