"""Corpus reports, evaluation, graph, session and live-table queries as relational plans.

A plan is written once, over named tables in braces, and runs in Spark as a DataFrame plan over those tables; the same
text, over the same files, is the check in another engine. Names after a dollar sign stand for what the two spell
differently. Sums of doubles are rounded, ties are broken by keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.sources.tables import read

#: How Spark and the checking engine spell the same function.
SPELLED = {
    "$matches": ("regexp_like", "regexp_matches"),
    "$epoch(": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ", "epoch_us("),
    "$last(topic)": ("last_value(topic, true)", "last_value(topic IGNORE NULLS)"),
    "$str": ("STRING", "VARCHAR"),
    "$sha256(": ("sha2(", "sha256("),
    "$bits": (", 256", ""),
    "$lines(text)": (r"explode(split(text, '\\n'))", "unnest(string_split(text, chr(10)))"),
}

#: Distinct values in order, joined by commas.
JOINED = (r"array_join(array_sort(collect_set(\1)), ',')", r"string_agg(DISTINCT \1, ',' ORDER BY \1)")

PLANS: dict[str, str] = {
    # F32, A2: rows with a missing value, and missing values of each column
    "dq_missing_summary": """
        SELECT source, count(*) AS n_rows, isum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS missing_text,
          isum(CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1 ELSE 0 END) AS missing_lang, isum(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) AS short_text
        FROM {documents} GROUP BY source""",
    # Share of texts with many marks, worst first
    "dq_suspicious_text": """
        WITH scored AS (SELECT source, doc_id, length(text) - length(translate(text, '#$%&*|', '')) AS marks FROM {documents}),
        books AS (SELECT source, count(*) AS n_chunks, isum(CASE WHEN marks >= 4 THEN 1 ELSE 0 END) AS n_suspicious FROM scored GROUP BY source)
        SELECT source, n_chunks, n_suspicious, round(n_suspicious / CAST(n_chunks AS DOUBLE), 4) AS ratio FROM books ORDER BY ratio DESC, source LIMIT 20""",
    # A3, DQ1: texts that stand more than once
    "dq_duplicates": """
        SELECT md5(text) AS digest, count(*) AS n_copies, count(DISTINCT source) AS n_sources, min(doc_id) AS first_doc FROM {documents} GROUP BY md5(text) HAVING count(*) > 1""",
    # Share of texts in a script
    "dq_script_ratio": """
        SELECT lang, count(*) AS n_docs, round(avg(CASE WHEN $matches(text, '[À-ÿ]') THEN 1.0 ELSE 0.0 END), 4) AS ratio FROM {documents} GROUP BY lang""",
    # Language guess and content status, the first rule that holds
    "content_status_ladder": """
        WITH f AS (SELECT doc_id, lang, length(text) AS n, (length(text) - length(translate(text, 'àâäáãåçéèêëíìîïñóòôöõúùûüß', ''))) / CAST(length(text) AS DOUBLE) AS share FROM {documents} WHERE length(text) > 0),
        g AS (SELECT *, CASE WHEN share < 0.002 THEN 'plain' WHEN share > 0.05 THEN 'accented' ELSE 'mixed' END AS guess FROM f)
        SELECT guess, CASE WHEN n < 100 THEN 'blocked' WHEN guess = 'plain' AND lang <> 'en' THEN 'review_required' WHEN guess = 'mixed' THEN 'draft' ELSE 'approved' END AS status, count(*) AS n_docs FROM g GROUP BY 1, 2""",
    # JN4, A7: a dashboard row for each book of either side
    "corpus_dashboard_full_outer": """
        WITH d AS (SELECT source, count(*) AS n_docs, isum(n_chars) AS n_chars, count(DISTINCT lang) AS n_langs FROM {documents} WHERE doc_id % 3 <> 0 GROUP BY source),
        l AS (SELECT d.source, count(*) AS n_labels, isum(toxic) AS n_toxic FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE d.doc_id % 2 = 0 GROUP BY d.source)
        SELECT coalesce(d.source, l.source) AS source, coalesce(n_docs, 0) AS n_docs, coalesce(n_chars, 0) AS n_chars, coalesce(n_langs, 0) AS n_langs, coalesce(n_labels, 0) AS n_labels, coalesce(n_toxic, 0) AS n_toxic, d.source IS NOT NULL AS materialized
        FROM d FULL OUTER JOIN l ON d.source = l.source""",
    # the same over all rows
    "corpus_dashboard_full_outer_all": """
        WITH d AS (SELECT source, count(*) AS n_docs, isum(n_chars) AS n_chars, count(DISTINCT lang) AS n_langs FROM {documents} GROUP BY source),
        l AS (SELECT d.source, count(*) AS n_labels, isum(toxic) AS n_toxic FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY d.source)
        SELECT coalesce(d.source, l.source) AS source, coalesce(n_docs, 0) AS n_docs, coalesce(n_chars, 0) AS n_chars, coalesce(n_langs, 0) AS n_langs, coalesce(n_labels, 0) AS n_labels, coalesce(n_toxic, 0) AS n_toxic, d.source IS NOT NULL AS materialized
        FROM d FULL OUTER JOIN l ON d.source = l.source""",
    # JN2, A24: approval of each book, missing sides count zero
    "approval_report": """
        WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id),
        b AS (SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_reviewed, isum(coalesce(l.quality, 0)) AS n_good, isum(coalesce(l.toxic, 0)) AS n_toxic FROM {documents} d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY d.source)
        SELECT *, CASE WHEN n_reviewed = 0 THEN 'unreviewed' WHEN n_toxic * 5 > n_reviewed THEN 'rejected' WHEN n_good * 10 >= n_reviewed * 9 THEN 'approved' ELSE 'needs_review' END AS status FROM b""",
    # Lane, priority and order of what is missing
    "gap_lane": """
        WITH b AS (SELECT source, lang, count(*) AS n, isum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) AS n_short FROM {documents} GROUP BY source, lang),
        lanes AS (SELECT *, CASE WHEN lang = 'en' AND n_short * 4 > n THEN 'rewrite' WHEN lang <> 'en' THEN 'translation' ELSE 'none' END AS lane FROM b)
        SELECT source, lang, n, n_short, lane, CASE lane WHEN 'rewrite' THEN 1 WHEN 'translation' THEN 2 ELSE 9 END AS priority, row_number() OVER (PARTITION BY lane ORDER BY n DESC, source, lang) AS position FROM lanes""",
    # JN7, U4: added, removed and changed rows between two snapshots
    "manifest_diff": """
        WITH a AS (SELECT doc_id, lang, n_chars FROM {documents}),
        b AS (SELECT vec_id AS doc_id, CASE WHEN label % 2 = 0 THEN 'en' ELSE 'de' END AS lang, vec_id * 7 AS n_chars FROM {embeddings})
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.lang IS DISTINCT FROM b.lang AS lang_differs, a.n_chars IS DISTINCT FROM b.n_chars AS size_differs
        FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id WHERE a.lang IS DISTINCT FROM b.lang OR a.n_chars IS DISTINCT FROM b.n_chars""",
    # JN8, U5: ids of one table that another lacks, both ways
    "id_consistency": """
        SELECT 'documents_without_labels' AS what, count(*) AS n FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id
        UNION ALL SELECT 'labels_without_documents', count(*) FROM {labels} l LEFT ANTI JOIN {documents} d ON d.doc_id = l.doc_id
        UNION ALL SELECT 'documents_without_vectors', count(*) FROM {documents} d LEFT ANTI JOIN {embeddings} e ON d.doc_id = e.vec_id""",
    # JN16: a language without its sibling
    "source_state_reconcile": """
        WITH langs AS (SELECT DISTINCT source, lang FROM {documents} WHERE doc_id % 11 < 2)
        SELECT source, lang, CASE WHEN lang = 'en' AND max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) OVER (PARTITION BY source) = 0 THEN 'en_only' WHEN lang = 'en' THEN 'en_with_sibling' ELSE 'other' END AS state FROM langs""",
    # the same over all rows
    "source_state_reconcile_all": """
        WITH langs AS (SELECT DISTINCT source, lang FROM {documents})
        SELECT source, lang, CASE WHEN lang = 'en' AND max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) OVER (PARTITION BY source) = 0 THEN 'en_only' WHEN lang = 'en' THEN 'en_with_sibling' ELSE 'other' END AS state FROM langs""",
    # JN9, JN10, A10, G3: pairs of books by how many signals they share
    "book_pair_edges": """
        WITH s AS (SELECT DISTINCT s_nationkey AS book, l_partkey AS signal FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey)
        SELECT a.book AS source_book, b.book AS target_book, count(*) AS weight, min(a.signal) AS first_signal FROM s a JOIN s b ON a.signal = b.signal AND a.book < b.book GROUP BY a.book, b.book""",
    # Signals that several books share
    "signal_hyperedges": """
        SELECT l_partkey AS signal, count(*) AS n_rows, count(DISTINCT s_nationkey) AS n_books FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_partkey HAVING count(DISTINCT s_nationkey) >= 2""",
    # JN11, JN13, R31: what related books among the first add to a hit
    "graph_boost": """
        WITH hits AS (SELECT doc_id, source AS book, round(1.0 / (60 + doc_id % 97), 6) AS score FROM {documents} WHERE doc_id < 200),
        edges AS (SELECT DISTINCT a.source AS x, b.source AS y, a.lang AS kind FROM {documents} a JOIN {documents} b ON a.doc_id = b.doc_id + 13 WHERE a.source <> b.source AND a.doc_id % 5 = 0),
        both_ways AS (SELECT x, y, kind FROM edges UNION SELECT y, x, kind FROM edges),
        seeds AS (SELECT book FROM (SELECT book, max(score) AS best FROM hits GROUP BY book) AS ranked ORDER BY best DESC, book LIMIT 5),
        support AS (SELECT x AS book, count(DISTINCT y) AS targets, count(DISTINCT kind) AS kinds FROM both_ways WHERE y IN (SELECT book FROM seeds) GROUP BY x)
        SELECT doc_id, h.book, round(score + least(0.35, least(0.18, 0.05 * coalesce(targets, 0)) + least(0.12, 0.02 * coalesce(kinds, 0))), 6) AS boosted FROM hits h LEFT JOIN support s ON h.book = s.book""",
    # the same for all documents, with all edges
    "graph_boost_all": """
        WITH hits AS (SELECT doc_id, source AS book, round(1.0 / (60 + doc_id % 97), 6) AS score FROM {documents}),
        edges AS (SELECT DISTINCT a.source AS x, b.source AS y, a.lang AS kind FROM {documents} a JOIN {documents} b ON a.doc_id = b.doc_id + 13 WHERE a.source <> b.source),
        both_ways AS (SELECT x, y, kind FROM edges UNION SELECT y, x, kind FROM edges),
        seeds AS (SELECT book FROM (SELECT book, max(score) AS best FROM hits GROUP BY book) AS ranked ORDER BY best DESC, book LIMIT 5),
        support AS (SELECT x AS book, count(DISTINCT y) AS targets, count(DISTINCT kind) AS kinds FROM both_ways WHERE y IN (SELECT book FROM seeds) GROUP BY x)
        SELECT doc_id, h.book, round(score + least(0.35, least(0.18, 0.05 * coalesce(targets, 0)) + least(0.12, 0.02 * coalesce(kinds, 0))), 6) AS boosted FROM hits h LEFT JOIN support s ON h.book = s.book""",
    # JN17: who links to a page, by host
    "backlinks": """
        WITH l AS (SELECT doc_id AS src, (doc_id * 7 + 3) % 500 AS dst FROM {documents} UNION ALL SELECT doc_id, (doc_id * 3) % 500 FROM {documents})
        SELECT dst, count(DISTINCT src) AS n_links, min(src) AS first_link FROM l WHERE src <> dst GROUP BY dst""",
    # Hit rates overall, by kind and by mode
    "eval_grouping_sets": """
        WITH cases AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'concept' WHEN item_id % 3 = 1 THEN 'procedure' ELSE 'reference' END AS query_type, CASE WHEN item_id % 2 = 0 THEN 'learn' ELSE 'ops' END AS mode, item_id % 20 AS expected FROM {benchmark}),
        ranked AS (SELECT c.item_id, c.query_type, c.mode, min(CASE WHEN d.doc_id % 20 = c.expected THEN r.rank END) AS first_hit
          FROM cases c JOIN (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}) r ON r.rank <= 25 JOIN {documents} d ON d.doc_id = r.doc_id GROUP BY c.item_id, c.query_type, c.mode)
        SELECT query_type, mode, count(*) AS n_cases, round(avg(CASE WHEN first_hit <= 1 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_1, round(avg(CASE WHEN first_hit <= 3 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_3, round(avg(CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_5
        FROM ranked GROUP BY GROUPING SETS ((), (query_type), (mode))""",
    # What a second stage gains and loses against the first
    "eval_ablation": """
        WITH s AS (SELECT doc_id, lang, quality = 1 AS first_ok, toxic = 0 AS second_ok FROM {labels} JOIN {documents} USING (doc_id))
        SELECT lang, count(*) AS n, isum(CASE WHEN second_ok AND NOT first_ok THEN 1 ELSE 0 END) AS gained, isum(CASE WHEN first_ok AND NOT second_ok THEN 1 ELSE 0 END) AS lost,
          round(avg(CASE WHEN second_ok THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN first_ok THEN 1.0 ELSE 0.0 END), 4) AS lift FROM s GROUP BY lang""",
    # Rates within the cases that have an expectation, zero if none has
    "eval_conditional_rates": """
        SELECT source, count(*) AS n, coalesce(round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE quality = 1), 4), 0) AS clean_if_good, coalesce(round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE quality = 0), 4), 0) AS clean_if_bad
        FROM {labels} JOIN {documents} USING (doc_id) GROUP BY source""",
    # The first cause that holds
    "failure_root_cause": """
        SELECT CASE WHEN d.n_chars < 200 THEN 'too_short' WHEN l.toxic = 1 AND l.quality = 0 THEN 'both' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'quality' WHEN e.vec_id IS NULL THEN 'no_vector' ELSE 'none' END AS cause, count(*) AS n
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id GROUP BY 1""",
    # Issues take from their axis; an axis with a critical one has nothing
    "quality_gate": """
        WITH axes AS (SELECT * FROM (VALUES ('structure', 25), ('text', 20), ('metadata', 20), ('citations', 20), ('safety', 15)) AS t(axis, weight)),
        issues AS (
          SELECT doc_id, 'text' AS axis, 8 AS points, false AS critical FROM {documents} WHERE n_chars < 500
          UNION ALL SELECT doc_id, 'structure', 5, false FROM {documents} WHERE text NOT LIKE '%.%'
          UNION ALL SELECT doc_id, 'metadata', 6, false FROM {documents} WHERE lang <> 'en'
          UNION ALL SELECT doc_id, 'safety', 15, true FROM {labels} WHERE toxic = 1
          UNION ALL SELECT doc_id, 'citations', 9, false FROM {labels} WHERE quality = 0),
        per_axis AS (SELECT d.doc_id, a.axis, CASE WHEN coalesce(max(CASE WHEN i.critical THEN 1 ELSE 0 END), 0) = 1 THEN 0 ELSE greatest(0, max(a.weight) - coalesce(isum(i.points), 0)) END AS score, coalesce(max(CASE WHEN i.critical THEN 1 ELSE 0 END), 0) AS failed
          FROM {documents} d CROSS JOIN axes a LEFT JOIN issues i ON i.doc_id = d.doc_id AND i.axis = a.axis GROUP BY d.doc_id, a.axis),
        total AS (SELECT doc_id, CAST(isum(score) AS BIGINT) AS score, max(failed) AS failed FROM per_axis GROUP BY doc_id)
        SELECT doc_id, score, CASE WHEN failed = 1 THEN 'blocked_artifact' WHEN score >= 90 THEN 'gold' WHEN score >= 78 THEN 'silver' WHEN score >= 60 THEN 'bronze' ELSE 'blocked_artifact' END AS verdict FROM total""",
    # 100 less penalties
    "upload_quality_score": """
        SELECT doc_id, 100 - CASE WHEN n_chars < 300 THEN 30 ELSE 0 END - CASE WHEN length(text) - length(translate(text, '#$%&*|', '')) > n_chars / 20 THEN 25 ELSE 0 END - CASE WHEN text NOT LIKE '%.%' THEN 15 ELSE 0 END AS score FROM {documents}""",
    # Reasons add up to a verdict
    "release_verdict": """
        SELECT source, bool_and(n_chars > 3) AS complete, bool_or(lang <> 'en') AS translated, CASE WHEN NOT bool_and(n_chars > 3) THEN 'blocked' WHEN bool_or(lang <> 'en') THEN 'needs_promotion' ELSE 'release_ready' END AS verdict FROM {documents} GROUP BY source""",
    # First five of each metric
    "metrics_top_pods": """
        WITH m AS (SELECT event_type, user_id, round(sum(value), 1) AS used FROM {events} GROUP BY event_type, user_id)
        SELECT * FROM (SELECT event_type, user_id, used, row_number() OVER (PARTITION BY event_type ORDER BY used DESC, user_id) AS rank FROM m) AS r WHERE rank <= 5""",
    # What is degraded, or one row that says that nothing is
    "degraded_or_info": """
        WITH bad AS (SELECT o_orderpriority AS name, isum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS ready, count(*) AS replicas FROM {orders} GROUP BY o_orderpriority HAVING isum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) * 2 < count(*))
        SELECT name, ready, replicas, 'high' AS severity FROM bad UNION ALL SELECT 'all', 0, 0, 'info' WHERE NOT EXISTS (SELECT 1 FROM bad)""",
    # Signals of each target
    "overlay_signals": """
        WITH w AS (SELECT user_id % 40 AS target, user_id, event_type AS kind, ts, CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 2 ELSE 1 END AS weight FROM {events}),
        k AS (SELECT target, kind, count(*) AS n, isum(weight) AS weight FROM w GROUP BY target, kind),
        main AS (SELECT target, kind AS main_kind FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, n DESC, kind) AS r FROM k) AS x WHERE r = 1)
        SELECT w.target, main_kind, count(*) AS n, count(DISTINCT user_id) AS n_users, isum(weight) AS score, $epoch(max(ts)) AS updated_us FROM w JOIN main ON w.target = main.target GROUP BY w.target, main_kind""",
    # Recency decides, each target keeps its best
    "overlay_recency_score": """
        WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS i FROM {events})
        SELECT user_id, event_type, max(greatest(10, 80 - 6 * i)) AS score FROM r WHERE i < 12 GROUP BY user_id, event_type""",
    # Each turn's parent
    "turn_lineage": """
        SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_role FROM {conversations}""",
    # The last topic that was set holds on
    "context_carry": """
        WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS topic FROM {conversations})
        SELECT conv_id, turn, $last(topic) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic FROM t""",
    # One row a session
    "session_summaries": """
        SELECT conv_id, min_by(text, turn) AS first_query, max_by(role, turn) AS last_role, count(*) AS n_turns, isum(length(text)) AS n_chars FROM {conversations} GROUP BY conv_id""",
    # ST6: history capped at the newest turns
    "turns_last_four": """
        SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {conversations}) AS x WHERE r <= 4""",
    # Newest hundred of each kind
    "audit_last_100": """
        SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM {events}) AS x WHERE r <= 100""",
    # Newest of each, then newest overall
    "unanswered_recent_distinct": """
        WITH latest AS (SELECT * FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events} WHERE event_type = 'error' OR value < 5) AS x WHERE r = 1)
        SELECT user_id, event_id FROM latest ORDER BY ts DESC, event_id DESC LIMIT 20""",
    # Replace by key, append what is new
    "upsert_by_key": """
        WITH new AS (SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM {orders} WHERE o_orderkey % 25 = 0)
        SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM {orders} o LEFT ANTI JOIN new n ON o.o_orderkey = n.o_orderkey UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM new""",
    # A group is replaced as a whole
    "group_replace": """
        SELECT doc_id, source, n_chars FROM {documents} WHERE source <> 'src1' UNION ALL SELECT doc_id, 'src1', CAST(quality + 2 * toxic AS BIGINT) FROM {labels}""",
    # Merged registry: largest count, any flag, first title that isn't blank
    "registry_upsert": """
        WITH r AS (SELECT source AS slug, n_chars AS n, doc_id % 7 = 0 AS active, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS title, doc_id FROM {documents})
        SELECT slug, max(n) AS n, bool_or(active) AS active, min_by(title, doc_id) FILTER (WHERE title <> '') AS title FROM r GROUP BY slug""",
    # Additive search score, first three
    "catalog_search_score": """
        WITH s AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) LIKE '%steel%' THEN 25 WHEN lower(p_type) LIKE '%steel%' THEN 10 ELSE 0 END + CASE WHEN lower(p_name) LIKE '%blue%' THEN 25 WHEN lower(p_type) LIKE '%blue%' THEN 10 ELSE 0 END + CASE WHEN p_size < 10 THEN 6 ELSE 0 END AS score FROM {part})
        SELECT p_partkey, p_name, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50""",
    # Rules as a table; factors multiply, boosts take the most
    "fusion_adjusted_rules": """
        WITH rules AS (SELECT * FROM (VALUES ('en', 1.05), ('de', 0.85), ('fr', 0.95)) AS t(lang, factor)), boosts AS (SELECT * FROM (VALUES ('src1', 1.2), ('src1', 1.4), ('src5', 0.82)) AS t(source, boost)),
        hits AS (SELECT doc_id, source, lang, 1.0 / (60 + row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS score FROM {documents}), b AS (SELECT source, max(boost) AS boost FROM boosts GROUP BY source)
        SELECT doc_id, h.source, round(CAST(score AS DOUBLE) * CAST(coalesce(factor, 1) AS DOUBLE) * CAST(coalesce(boost, 1) AS DOUBLE), 8) AS score FROM hits h LEFT JOIN rules r ON h.lang = r.lang LEFT JOIN b ON h.source = b.source""",
    # what may be shown
    "latest_only_filter": """
        SELECT doc_id, source FROM {documents} WHERE NOT $matches(trim(text), '^[A-Z]{{40,}}') AND (n_chars > 500 OR source NOT IN (SELECT CONCAT('src', CAST(s_nationkey AS $str)) FROM {supplier}) OR lang = 'en')""",
    # whether the first hit is confident and whether books compete
    "confidence_flags": """
        WITH h AS (SELECT lang AS q, source, n_chars AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents})
        SELECT q, count(DISTINCT source) >= 2 AND max(CASE WHEN rank = 2 THEN score END) >= 0.92 * max(CASE WHEN rank = 1 THEN score END) AS ambiguous, max(CASE WHEN rank = 2 THEN score END) < 0.88 * max(CASE WHEN rank = 1 THEN score END) AS confident FROM h WHERE rank <= 3 GROUP BY q""",
    # The first of each identity
    "citation_dedupe": """
        SELECT doc_id, source, excerpt FROM (SELECT doc_id, source, substr(text, 1, 40) AS excerpt, row_number() OVER (PARTITION BY source, lower(substr(text, 1, 40)) ORDER BY doc_id) AS r FROM {documents}) AS x WHERE r = 1""",
    # the same by the whole text
    "citation_dedupe_all": """
        SELECT min(doc_id) AS doc_id, source, min_by(substr(text, 1, 40), doc_id) AS excerpt FROM {documents} GROUP BY source, md5(lower(text))""",
    # fingerprints
    "source_fingerprints": """
        SELECT doc_id, $sha256(concat(source, '|', lang, '|', CAST(n_chars AS $str))$bits) AS fingerprint FROM {documents}""",
    # Counts of kinds for each day
    "overlay_daily": """
        SELECT CAST(CAST(ts AS DATE) AS $str) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2""",
    # beyond the reference: event-time tumbling windows
    "event_tumbling": """
        SELECT floor($epoch(ts) / 3600000000) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY 1, 2""",
    # beyond the reference: sessions by gaps of half an hour
    "event_sessions": """
        WITH g AS (SELECT user_id, $epoch(ts) AS us, CASE WHEN $epoch(ts) - lag($epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS starts, event_id FROM {events}),
        s AS (SELECT user_id, us, sum(starts) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY user_id, session""",
    # JN14, A20, W7: best and second family of each source by shared words
    "family_winner": """
        WITH heads AS (SELECT DISTINCT source, lang, doc_id % 40 AS token FROM {documents}), sizes AS (SELECT source, lang, count(*) AS n FROM heads GROUP BY source, lang),
        p AS (SELECT a.source, a.lang, b.lang AS family, count(*) AS shared FROM heads a JOIN heads b ON a.source = b.source AND a.token = b.token AND a.lang < b.lang GROUP BY a.source, a.lang, b.lang),
        s AS (SELECT p.source, p.lang, family, round(0.55 * shared / x.n + 0.20 * shared / y.n, 6) AS score FROM p JOIN sizes x ON x.source = p.source AND x.lang = p.lang JOIN sizes y ON y.source = p.source AND y.lang = p.family),
        r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, family) AS rank, lead(score) OVER (PARTITION BY source, lang ORDER BY score DESC, family) AS next FROM s)
        SELECT source, lang, family, score, round(score - coalesce(next, 0), 6) AS margin FROM r WHERE rank = 1""",
}


def _whole_sums(text: str, engine: int) -> str:
    """isum( is a sum of whole numbers, which the checking engine would make wider."""
    while (at := text.find("isum(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[at + 5 : end - 1]
        text = text[:at] + (f"sum({inner})" if engine == 0 else f"CAST(sum({inner}) AS BIGINT)") + text[end:]
    return text


def _spell(text: str, engine: int) -> str:
    for name, forms in SPELLED.items():
        text = text.replace(name, forms[engine])
    text = re.sub(r"\$join\((\w+)\)", JOINED[engine], text)
    # decimals are doubles
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", _whole_sums(text, engine))


def _tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def query_of(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_spell(text, 0), **{t: read(spark, sf_dir, t) for t in _tables(text)})

    return run


def check_of(text: str) -> str:
    text = re.sub(r"LEFT ANTI JOIN", "ANTI JOIN", _spell(text, 1))
    return text.format(**{t: t for t in _tables(text)})


# the names of queries that began on parts of their tables stand for all rows too
PLANS |= {name.removesuffix("_all"): text for name, text in PLANS.items() if name.endswith("_all")}
QUERIES = {name: query_of(text) for name, text in PLANS.items()}
ORACLES = {name: check_of(text) for name, text in PLANS.items()}
