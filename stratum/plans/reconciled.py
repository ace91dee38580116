"""Queries over merges, backlinks, verdicts and evaluations, and checks that are written on their own.

Customers, orders, parts and events stand for queries, hits, books and issues; all rows of a table are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import reconcile, rules
from stratum.sources.tables import read


def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier, customer = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    first = nation.select(F.col("n_nationkey").alias("slug"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("title"), F.lit(" ").alias("owner"))
    second = supplier.groupBy(F.col("s_nationkey").alias("slug")).agg(F.max("s_name").alias("title"), F.lit("").alias("owner"))
    third = customer.groupBy((F.col("c_nationkey") + 5).alias("slug")).agg(F.min("c_name").alias("title"), F.max("c_mktsegment").alias("owner"))
    return reconcile.merged([first, second, third], "slug", ["title", "owner"])


def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlay = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.when(F.max("l_quantity") >= 49, F.concat(F.lit("sold "), F.count("*").cast("string"))).alias("p_brand"))
    return reconcile.overlaid(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), overlay, "p_partkey", ["p_brand"])


def related_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    hits = orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("book"))
    pairs = orders.groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target")).agg(F.count("*").alias("weight"))
    known = pairs.filter(F.col("source").startswith("1") | F.col("source").startswith("3"))
    return reconcile.related_or_fallback(hits, known, pairs.filter("target = 'O'")).select("doc_id", "book", "target", "weight", "origin")


def entity_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents say the first two words of each item."""
    entities = read(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ").alias("entity")).distinct()
    return reconcile.entity_backlinks(read(spark, sf_dir, "documents"), "doc_id", "text", entities)


def figures_in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one type open sections; the others are figures in them."""
    events = read(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type")).first()[0]
    opened = events.filter(F.col("event_type") == kind).groupBy("user_id", F.col("ts").alias("at")).agg(F.min("event_id").cast("string").alias("anchor"))
    figures = events.filter(F.col("event_type") != kind).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("figure"))
    return reconcile.nearest_section(figures, opened, "user_id").select(F.col("figure").cast("long").alias("figure"), "user_id", "anchor")


def family_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_returnflag").alias("family"), F.col("l_quantity").alias("score"), F.col("l_tax").alias("margin"))
    return reconcile.family_verdict(winners, share=0.4)


AXES = {"click": 25, "view": 20, "purchase": 15}


def quality_gate_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is an issue of its user, on the axis of its type, as grave as its value."""
    value = F.col("value")
    severity = F.when(value < 10, "low").when(value < 50, "medium").when(value < 100, "high").otherwise("critical")
    issues = read(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.col("event_type").alias("axis"), severity.alias("severity"), (F.col("event_id") % 97 == 0).alias("fails"))
    return reconcile.quality_gate(issues, AXES)


def citations_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines cite, and its lines are hits: those of one ship mode and part group are one place."""
    lines = read(spark, sf_dir, "lineitem")
    place = [F.lit(None).cast("string").alias("viewer_path"), F.concat(F.lit(" HTTP://x/"), F.col("l_returnflag")).alias("source_url"), (F.col("l_partkey") % 3).cast("string").alias("anchor")]
    cited = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("number"), F.col("l_linestatus").alias("book"), *place)
    hits = lines.filter("l_quantity > 10").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("book"), *place)
    return rules.matched_citations(cited, hits)


def answers_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    cases = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer"), words("the", "And  a", "der").alias("must"), words("zz", "qu").alias("must_not"), F.array("source", F.lit("src1")).alias("expected"), F.array(F.lit("src1"), F.lit("src2"), F.lit("src3")).alias("cited"))
    told = rules.eval_terms(cases)
    return told.select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("forbidden", ",").alias("forbidden"), "precision", "passed")


QUERIES = {f.__name__: f for f in (registry_merge, overlay_merge, related_books, entity_backlinks, figures_in_sections, family_verdicts, quality_gate_by_severity, citations_of_hits, answers_by_terms)}
_SAID = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_PLACE = "l_orderkey AS query_id, l_linestatus AS book, lower(trim(' HTTP://x/' || l_returnflag)) || '#' || (l_partkey % 3) AS identity"
_SEVERITY = "CASE WHEN value < 10 THEN 1 WHEN value < 50 THEN 3 WHEN value < 100 THEN 6 ELSE 10 END"
_AXIS = "(CASE WHEN coalesce(bool_or(event_type = '{0}' AND event_id % 97 = 0), false) THEN 0 ELSE greatest(0, 100 - coalesce(sum(CASE WHEN event_type = '{0}' THEN " + _SEVERITY + " END), 0)) END)::INT"
ORACLES = {
    "registry_merge": """WITH a AS (SELECT n_nationkey AS slug, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS t FROM nation), b AS (SELECT s_nationkey AS slug, max(s_name) AS t FROM supplier GROUP BY s_nationkey), c AS (SELECT c_nationkey + 5 AS slug, min(c_name) AS t, max(c_mktsegment) AS o FROM customer GROUP BY c_nationkey)
SELECT slug, coalesce(a.t, b.t, c.t) AS title, o AS owner, CASE WHEN slug IN (SELECT slug FROM a) THEN 0 WHEN slug IN (SELECT slug FROM b) THEN 1 ELSE 2 END::INT AS layer FROM a FULL JOIN b USING (slug) FULL JOIN c USING (slug)""",
    "overlay_merge": "SELECT p_partkey, p_name, coalesce((SELECT CASE WHEN max(l_quantity) >= 49 THEN 'sold ' || count(*) END FROM lineitem WHERE l_partkey = p_partkey), p_brand) AS p_brand FROM part",
    "related_books": """WITH p AS (SELECT o_orderpriority AS book, o_orderstatus AS target, count(*) AS weight FROM orders GROUP BY ALL)
SELECT o_orderkey AS doc_id, book, target, weight, CASE WHEN book[1] IN ('1', '3') THEN 'relation' ELSE 'fallback' END AS origin FROM orders JOIN p ON o_orderpriority = book WHERE book[1] IN ('1', '3') OR target = 'O'""",
    "entity_backlinks": rf"""WITH e AS (SELECT DISTINCT array_to_string(string_split_regex(trim(text), '\s+')[1:2], ' ') AS entity FROM benchmark), d AS (SELECT doc_id, ' ' || regexp_replace({_SAID}, '[^\p{{L}}\p{{N}}-]+', ' ', 'g') || ' ' AS said FROM documents)
SELECT DISTINCT entity, doc_id FROM e JOIN d ON contains(said, ' ' || lower(entity) || ' ')""",
    "figures_in_sections": """WITH k AS (SELECT min(event_type) AS kind FROM events), s AS (SELECT user_id, ts, min(event_id)::VARCHAR AS anchor FROM events, k WHERE event_type = kind GROUP BY ALL), f AS (SELECT event_id AS figure, user_id, ts FROM events, k WHERE event_type <> kind)
SELECT figure, f.user_id, anchor FROM f ASOF LEFT JOIN s ON f.user_id = s.user_id AND f.ts >= s.ts""",
    "family_verdicts": """WITH w AS (SELECT l_suppkey AS book, l_returnflag AS family, count(*) AS n_won, round(avg(l_quantity), 6) AS mean_score, avg(l_tax) AS margin FROM lineitem GROUP BY ALL), s AS (SELECT *, n_won / sum(n_won) OVER (PARTITION BY book) AS share FROM w)
SELECT book, family, n_won, mean_score, round(share, 6) AS share, share >= 0.4e0 AND margin >= 0.01e0 AS ready FROM s QUALIFY row_number() OVER (PARTITION BY book ORDER BY n_won DESC, mean_score DESC, family) = 1""",
    "quality_gate_by_severity": f"""SELECT * EXCLUDE (failed) FROM (WITH g AS (SELECT user_id AS book, {', '.join(_AXIS.format(a) + ' AS ' + a for a in AXES)}, bool_or(event_id % 97 = 0) AS failed FROM events GROUP BY user_id)
SELECT *, CASE WHEN failed THEN 'blocked' WHEN total >= 90 THEN 'gold' WHEN total >= 78 THEN 'silver' WHEN total >= 60 THEN 'bronze' ELSE 'review' END AS verdict FROM (SELECT *, round((25 * click + 20 * view + 15 * purchase) / 60, 4) AS total FROM g))""",
    "citations_of_hits": f"""WITH h AS (SELECT {_PLACE}, max(l_extendedprice) AS score, max({{'s': l_extendedprice, 'd': l_partkey}}) AS best FROM lineitem WHERE l_quantity > 10 GROUP BY ALL), c AS (SELECT {_PLACE}, l_linenumber AS number FROM lineitem)
SELECT c.query_id, number, c.book, c.identity, best.d AS doc_id, score FROM c LEFT JOIN h ON c.query_id = h.query_id AND c.book = h.book AND c.identity = h.identity""",
    "answers_by_terms": f"""WITH s AS (SELECT doc_id, source, {_SAID} AS said FROM documents), t AS (SELECT *, concat_ws(',', CASE WHEN NOT contains(said, 'the') THEN 'the' END, CASE WHEN NOT contains(said, 'and a') THEN 'And  a' END, CASE WHEN NOT contains(said, 'der') THEN 'der' END) AS missing, concat_ws(',', CASE WHEN contains(said, 'zz') THEN 'zz' END, CASE WHEN contains(said, 'qu') THEN 'qu' END) AS forbidden FROM s)
SELECT doc_id, missing, forbidden, round(CASE WHEN source IN ('src2', 'src3') THEN 2 ELSE 1 END / 3, 4) AS precision, missing = '' AND forbidden = '' AS passed FROM t""",
}
