"""Rule tables, decision ladders, selections and keyed state as relational plans, in the way of reports.

A ladder takes the first rule that holds. Rules that only hold for one product are rows of a table here, so that a user
puts in other rows.
"""

from __future__ import annotations

from .reports import check_of, query_of

PLANS: dict[str, str] = {
    # Hit rates of each stage, by unpivoting
    "stage_hit_rates": """
        WITH c AS (SELECT doc_id, doc_id % 9 AS bm25, doc_id % 7 AS vector, doc_id % 5 AS fused FROM {documents}),
        s AS (SELECT 'bm25' AS stage, bm25 AS rank FROM c UNION ALL SELECT 'vector', vector FROM c UNION ALL SELECT 'fused', fused FROM c)
        SELECT stage, count(*) AS n, round(avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_1, round(avg(CASE WHEN rank < 3 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_3 FROM s GROUP BY stage""",
    # Rates overall and by category, with denominators of one at least
    "benchmark_summary": """
        WITH c AS (SELECT lang AS category, source AS mode, n_chars > 1500 AS hit FROM {documents})
        SELECT category, mode, count(*) AS n, round(isum(CASE WHEN hit THEN 1 ELSE 0 END) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS rate FROM c GROUP BY GROUPING SETS ((), (category), (mode))""",
    # Answer rates and the assessment they lead to
    "answer_summary": """
        WITH a AS (SELECT lang, quality, toxic FROM {labels} JOIN {documents} USING (doc_id)),
        r AS (SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 4) AS pass_rate, coalesce(round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE quality = 0), 4), 0.0) AS safe_if_poor FROM a GROUP BY lang)
        SELECT *, CASE WHEN pass_rate >= 0.9 THEN 'strong' WHEN pass_rate >= 0.75 THEN 'usable' WHEN pass_rate >= 0.5 THEN 'weak' ELSE 'failing' END AS assessment FROM r""",
    # Stage histogram and the queue that is open
    "translation_lane": """
        WITH s AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'original' WHEN n_chars % 3 = 0 THEN 'approved' WHEN n_chars % 3 = 1 THEN 'draft' ELSE 'blocked' END AS stage FROM {documents})
        SELECT source, stage, count(*) AS n, stage NOT IN ('approved', 'original') AS active FROM s GROUP BY source, stage""",
    # Readiness of each bundle
    "bundle_readiness": """
        WITH b AS (SELECT source, count(*) AS n, isum(CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END) AS n_full, count(DISTINCT lang) AS n_langs FROM {documents} GROUP BY source)
        SELECT source, n, n_full, CASE WHEN n_langs >= 4 AND n_full * 4 >= n * 3 THEN 'promoted' WHEN n_full * 2 >= n THEN 'ready' WHEN n_full > 0 THEN 'partial' ELSE 'empty' END AS readiness FROM b""",
    # Before, after and difference of two runs
    "run_delta": """
        WITH a AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source), b AS (SELECT source, count(*) AS n FROM {documents} JOIN {labels} USING (doc_id) GROUP BY source)
        SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS before_n, coalesce(b.n, 0) AS after_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL OUTER JOIN b ON a.source = b.source""",
    # Counts that two reports should share
    "drift_counts": """
        WITH d AS (SELECT lang, count(*) AS n FROM {documents} GROUP BY lang), l AS (SELECT lang, count(DISTINCT l.doc_id) AS n FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY lang)
        SELECT d.lang, d.n AS expected, coalesce(l.n, 0) AS found, d.n <> coalesce(l.n, 0) AS drift FROM d LEFT JOIN l ON d.lang = l.lang""",
    # Distinct values of each group in order
    "distinct_rollup": """
        SELECT source, $join(lang) AS langs, count(DISTINCT lang) AS n_langs FROM {documents} GROUP BY source""",
    # One label for several origins, or that of the first
    "citation_truth": """
        WITH c AS (SELECT source, CASE WHEN lang = 'en' THEN 'official' ELSE 'private' END AS truth, doc_id FROM {documents} WHERE doc_id % 6 = 0)
        SELECT source, CASE WHEN count(DISTINCT truth) > 1 THEN 'mixed' ELSE min_by(truth, doc_id) END AS truth, count(*) AS n FROM c GROUP BY source""",
    # the same over all rows
    "citation_truth_all": """
        WITH c AS (SELECT source, CASE WHEN lang = 'en' THEN 'official' ELSE 'private' END AS truth, doc_id FROM {documents})
        SELECT source, CASE WHEN count(DISTINCT truth) > 1 THEN 'mixed' ELSE min_by(truth, doc_id) END AS truth, count(*) AS n FROM c GROUP BY source""",
    # How many candidates a search may take
    "candidate_budget": """
        SELECT doc_id, CASE WHEN n_chars < 100 THEN NULL ELSE least(n_chars % 40, greatest(n_chars % 11, CASE WHEN lang = 'en' THEN 5 ELSE 6 END)) END AS budget FROM {documents}""",
    # Sections by priority, each once, up to a cap
    "derived_sections": """
        WITH p AS (SELECT source, doc_id, 1 AS priority FROM {documents} WHERE n_chars > 4000 UNION ALL SELECT source, doc_id, 2 FROM {documents} WHERE lang = 'de' UNION ALL SELECT source, doc_id, 3 FROM {documents}),
        once AS (SELECT source, doc_id, min(priority) AS priority FROM p GROUP BY source, doc_id)
        SELECT source, doc_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, doc_id) AS r FROM once) AS x WHERE r <= 6""",
    # A limit that grows with the group; the chosen ones in their own order
    "family_selection": """
        WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM {documents})
        SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM s WHERE r <= least(12, greatest(3, ceil(n * 0.1)))""",
    # Additive score, category by ladder
    "repository_ranking": """
        WITH s AS (SELECT p_partkey, p_name, CASE WHEN p_name LIKE '%steel%' THEN 4 WHEN p_type LIKE '%STEEL%' THEN 2 ELSE 1 END + CASE WHEN p_retailprice > 1500 THEN 2 ELSE 0 END AS score, CASE WHEN p_size > 40 THEN 'operator' WHEN p_type LIKE '%BRASS%' THEN 'manual' ELSE 'other' END AS category FROM {part})
        SELECT category, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, p_partkey) AS r FROM s) AS x WHERE r <= 20""",
    # Books that two lists share among their first five
    "overlap_books": """
        WITH a AS (SELECT lang, source FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY max(n_chars) DESC, source) AS r FROM {documents} GROUP BY lang, source) AS x WHERE r <= 5),
        b AS (SELECT lang, source FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM {documents} GROUP BY lang, source) AS x WHERE r <= 5)
        SELECT a.lang, count(*) AS n, $join(source) AS shared FROM a JOIN b USING (lang, source) GROUP BY a.lang""",
    # U8: upsert by a key of several columns
    "identity_upsert": """
        WITH old AS (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang), new AS (SELECT source, lang, count(*) * 100 AS n FROM {documents} JOIN {labels} USING (doc_id) GROUP BY source, lang)
        SELECT source, lang, n FROM old LEFT ANTI JOIN new USING (source, lang) UNION ALL SELECT source, lang, n FROM new""",
    # Rows of some classes are kept, the others built anew
    "retain_by_class": """
        SELECT doc_id, lang, 'kept' AS origin FROM {documents} WHERE lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, lang, 'rebuilt' FROM {documents} WHERE lang IN ('en', 'de') AND n_chars > 1000""",
    # The last of several tables wins
    "union_last_wins": """
        WITH u AS (SELECT doc_id % 300 AS slug, n_chars, 1 AS pass, doc_id FROM {documents} UNION ALL SELECT doc_id % 300, n_chars * 2, 2, doc_id FROM {documents} WHERE lang = 'fr')
        SELECT slug, n_chars, pass FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pass DESC, doc_id DESC) AS r FROM u) AS x WHERE r = 1""",
    # One uploaded hit leads, the list keeps its length
    "uploaded_preserved": """
        WITH h AS (SELECT lang, doc_id, doc_id % 17 = 0 AS uploaded, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}),
        lead AS (SELECT lang, min_by(doc_id, rank) AS doc_id FROM h WHERE uploaded GROUP BY lang)
        SELECT lang, doc_id, position FROM (SELECT h.lang, h.doc_id, row_number() OVER (PARTITION BY h.lang ORDER BY CASE WHEN l.doc_id IS NOT NULL THEN 0 ELSE 1 END, rank) AS position FROM h LEFT JOIN lead l ON h.lang = l.lang AND h.doc_id = l.doc_id) AS x WHERE position <= 8""",
    # Type and size of a chunk
    "chunk_profile": """
        SELECT doc_id, CASE WHEN text LIKE '%|%' THEN 'reference' WHEN text LIKE '%!!%' THEN 'warning' WHEN n_chars < 300 THEN 'command' WHEN lang <> 'en' THEN 'concept' ELSE 'procedure' END AS chunk_type, CASE WHEN text LIKE '%|%' THEN 320 WHEN n_chars < 300 THEN 240 ELSE 160 END AS size, CASE WHEN text LIKE '%|%' OR n_chars < 300 THEN 0 ELSE 32 END AS overlap FROM {documents}""",
    # A stated status goes before what rules would give
    "contract_status": """
        WITH s AS (SELECT d.doc_id, CASE WHEN d.doc_id % 19 = 0 THEN 'published' END AS stated, quality, toxic FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id)
        SELECT doc_id, CASE WHEN stated IS NOT NULL THEN stated WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'published' ELSE 'candidate' END AS status FROM s""",
    # Why a query is rewritten, or not
    "rewrite_decision": """
        WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before_text FROM {conversations})
        SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'not_a_query' WHEN before_text IS NULL THEN 'first_turn' WHEN length(text) < 60 THEN 'short_follow_up' WHEN text LIKE '%?%' THEN 'question' ELSE 'kept' END AS decision FROM t""",
    # whether more work pays off
    "expansion_decision": """
        WITH h AS (SELECT lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}),
        q AS (SELECT lang, count(DISTINCT source) AS n_books, max(CASE WHEN rank = 1 THEN n_chars END) AS first_score, max(CASE WHEN rank = 2 THEN n_chars END) AS second_score FROM h WHERE rank <= 5 GROUP BY lang)
        SELECT lang, CASE WHEN n_books = 1 THEN 'single_book' WHEN second_score >= 0.92 * first_score THEN 'close_books' WHEN n_books >= 4 THEN 'many_books' ELSE 'confident' END AS reason FROM q""",
    # whether to ask back
    "clarification_flags": """
        WITH h AS (SELECT source, n_chars / 1000000.0 AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}),
        q AS (SELECT source, max(CASE WHEN rank = 1 THEN score END) AS first_score, max(CASE WHEN rank = 2 THEN score END) AS second_score FROM h WHERE rank <= 2 GROUP BY source)
        SELECT source, first_score < 0.018 AS low, coalesce(second_score >= 0.94 * first_score, false) AS close_competitor, coalesce(first_score - second_score < 0.0025, false) AS small_margin FROM q""",
    # follow-ups by words and beginnings
    "follow_up_flags": """
        SELECT conv_id, turn, $matches(lower(text), '(^|[^a-z])(this|that|it|them)([^a-z]|$)') AS refers, lower(text) LIKE 'on %' OR lower(text) LIKE 'in %' AS begins_like_one, length(text) - length(replace(text, '?', '')) AS n_questions FROM {conversations} WHERE role = 'user'""",
    # All must hold; the first that doesn't is named
    "runtime_eligibility": """
        WITH e AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey)
        SELECT c_custkey, c_acctbal > 0 AND n_name IS NOT NULL AND c_mktsegment <> 'MACHINERY' AS eligible, CASE WHEN n_name IS NULL THEN 'no_scope' WHEN c_mktsegment = 'MACHINERY' THEN 'blocked_class' WHEN c_acctbal <= 0 THEN 'not_approved' ELSE '' END AS reason FROM e""",
    # titles that look wrong
    "title_checks": """
        SELECT page_id, length(regexp_extract(html, '<title>([^<]*)', 1)) - length(replace(regexp_extract(html, '<title>([^<]*)', 1), '?', '')) >= 2 AS many_marks, $matches(regexp_extract(html, '<title>([^<]*)', 1), '[A-Za-z]') AND NOT $matches(regexp_extract(html, '<title>([^<]*)', 1), '[가-힣]') AS latin_only FROM {pages}""",
    # Kinds of lines
    "line_kinds": """
        WITH l AS (SELECT doc_id, $lines(text) AS line FROM {documents}),
        k AS (SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN line LIKE '%|%' THEN 'table' WHEN $matches(line, '^[A-Z!,. ]+$') THEN 'shout' WHEN $matches(line, '[#*$%&]') THEN 'marks' ELSE 'prose' END AS kind FROM l)
        SELECT doc_id, kind, count(*) AS n FROM k GROUP BY doc_id, kind""",
    # Terms that a query's rules add
    "term_expansion": """
        WITH rules AS (SELECT * FROM (VALUES ('the', 'article'), ('der', 'artikel'), ('tion', 'noun'), ('ment', 'noun'), ('que', 'relative')) AS t(pattern, term))
        SELECT item_id, $join(term) AS terms, count(DISTINCT term) AS n FROM {benchmark} JOIN rules ON text LIKE concat('%', pattern, '%') GROUP BY item_id""",
    # The largest boost and the smallest penalty of each book
    "book_boosts": """
        WITH rules AS (SELECT * FROM (VALUES ('en', 'src1', 1.2, 1.0), ('en', 'src1', 1.5, 0.9), ('de', 'src2', 1.0, 0.6), ('de', 'src2', 1.1, 0.8)) AS t(lang, source, boost, penalty)),
        m AS (SELECT lang, source, max(boost) AS boost, min(penalty) AS penalty FROM rules GROUP BY lang, source)
        SELECT doc_id, round(n_chars * coalesce(boost, 1.0) * coalesce(penalty, 1.0), 6) AS score FROM {documents} d LEFT JOIN m ON d.lang = m.lang AND d.source = m.source""",
    # A rule orders the list anew by priority, rank and keys
    "rebalanced_hits": """
        WITH h AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}), top AS (SELECT * FROM h WHERE rank <= 20),
        flag AS (SELECT lang, max(CASE WHEN rank = 1 AND source IN ('src0', 'src1', 'src2') THEN 1 ELSE 0 END) AS fires FROM top GROUP BY lang)
        SELECT t.lang, doc_id, rank AS before_rank, row_number() OVER (PARTITION BY t.lang ORDER BY CASE WHEN fires = 1 AND source IN ('src5', 'src6') THEN 0 ELSE 1 END, rank, source, doc_id) AS after_rank FROM top t JOIN flag f ON t.lang = f.lang""",
    # Summary of a list before and after
    "hit_summary": """
        WITH h AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 1000 DESC, doc_id) AS b FROM {documents})
        SELECT lang, count(*) AS n, max(n_chars) AS top_score, max(CASE WHEN a = 1 THEN doc_id END) AS top_before, max(CASE WHEN b = 1 THEN doc_id END) AS top_after, isum(CASE WHEN a <= 10 AND b <= 10 THEN 1 ELSE 0 END) AS shared_ten FROM h GROUP BY lang""",
    # The first of each class stays
    "mixed_citations": """
        SELECT source, lang = 'en' AS official, min(doc_id) AS doc_id FROM {documents} GROUP BY source, lang = 'en'""",
    # Additive link score, direct ones first
    "related_sections": """
        WITH n AS (SELECT doc_id, lead(doc_id, 1) OVER w AS d1, lead(doc_id, 2) OVER w AS d2, lead(doc_id, 3) OVER w AS d3, lead(doc_id, 4) OVER w AS d4, lang, lead(lang, 1) OVER w AS l1, lead(lang, 2) OVER w AS l2, lead(lang, 3) OVER w AS l3, lead(lang, 4) OVER w AS l4, n_chars FROM {documents} WINDOW w AS (PARTITION BY source, n_chars % 97 ORDER BY n_chars, doc_id)),
        p AS (SELECT doc_id AS src, dst, 300 + CASE WHEN lang = other THEN 120 ELSE 0 END + 15 * (n_chars % 5) - k AS score FROM (SELECT doc_id, d1 AS dst, lang, l1 AS other, n_chars, 1 AS k FROM n UNION ALL SELECT doc_id, d2, lang, l2, n_chars, 2 FROM n UNION ALL SELECT doc_id, d3, lang, l3, n_chars, 3 FROM n UNION ALL SELECT doc_id, d4, lang, l4, n_chars, 4 FROM n) AS c WHERE dst IS NOT NULL)
        SELECT src, dst, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p) AS x WHERE rank <= 3""",
    # G1: rows of one table win, the other fills what is absent
    "book_index": """
        WITH p AS (SELECT source AS slug, min(lang) AS title FROM {documents} WHERE doc_id % 29 = 0 GROUP BY source), c AS (SELECT source AS slug, max(lang) AS title, count(*) AS n FROM {documents} GROUP BY source)
        SELECT c.slug, coalesce(p.title, c.title) AS title, c.n, p.slug IS NOT NULL AS listed FROM c LEFT JOIN p ON c.slug = p.slug""",
    # the same over all rows: labelled books are the one table, all books the other
    "book_index_all": """
        WITH p AS (SELECT source AS slug, min(lang) AS title FROM {labels} JOIN {documents} USING (doc_id) GROUP BY source), c AS (SELECT source AS slug, max(lang) AS title, count(*) AS n FROM {documents} GROUP BY source)
        SELECT c.slug, coalesce(p.title, c.title) AS title, c.n, p.slug IS NOT NULL AS listed FROM c LEFT JOIN p ON c.slug = p.slug""",
    # One row for each kind of an edge
    "edge_unpivot": """
        SELECT least(a.source, b.source) AS x, greatest(a.source, b.source) AS y, a.lang AS kind, count(*) AS weight FROM {documents} a JOIN {documents} b ON a.doc_id = b.doc_id + 1 WHERE a.source <> b.source GROUP BY 1, 2, 3""",
    # Whether what was built is older than what it is built from
    "artifact_freshness": """
        WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN ts END) AS built, max(CASE WHEN event_type = 'purchase' THEN ts END) AS input FROM {events} GROUP BY user_id)
        SELECT user_id, CASE WHEN built IS NULL THEN 'missing' WHEN input IS NULL THEN 'unknown' WHEN input > built THEN 'stale' ELSE 'fresh' END AS state, CASE WHEN input > built THEN ($epoch(input) - $epoch(built)) / 1000000.0 ELSE 0.0 END AS stale_seconds FROM s""",
    # Hits and forbidden ones among the first k
    "hits_at_k": """
        WITH h AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents})
        SELECT lang, bool_or(rank <= 1 AND source IN ('src0', 'src3')) AS hit_1, bool_or(rank <= 5 AND source IN ('src0', 'src3')) AS hit_5, bool_or(rank <= 5 AND source = 'src9') AS forbidden_5 FROM h GROUP BY lang""",
    # ST2, ST3: the newest state of each key, without deleted ones
    "session_upsert": """
        WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events})
        SELECT user_id, event_id, value FROM e WHERE r = 1 AND event_type <> 'error'""",
    # ST10, ST11: overlays by user, kind and target; a later removal takes one away
    "overlay_state": """
        WITH e AS (SELECT user_id, event_id % 5 AS target, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC, event_id DESC) AS r FROM {events})
        SELECT user_id, target, event_type AS last_kind FROM e WHERE r = 1 AND event_type <> 'signup'""",
    # ST17: the last value that each key was given
    "progress_state": """
        SELECT event_type, max_by(user_id, event_id) AS last_user, count(*) AS n FROM {events} GROUP BY event_type""",
    # JN15, DQ6: how often a key stands on each side
    "runtime_truth": """
        WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT c_custkey AS k, count(*) AS n FROM {customer} GROUP BY c_custkey)
        SELECT CASE WHEN b.n IS NULL THEN 'orphan' WHEN a.n IS NULL THEN 'unused' WHEN a.n > 20 THEN 'heavy' ELSE 'ok' END AS state, count(*) AS n FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY 1""",
    # DQ8: fail-closed reasons, in order
    "read_boundary": """
        SELECT s_suppkey, concat(CASE WHEN s_acctbal < 0 THEN 'balance;' ELSE '' END, CASE WHEN s_nationkey % 5 = 0 THEN 'scope;' ELSE '' END, CASE WHEN s_name LIKE '%7' THEN 'placeholder;' ELSE '' END) AS reasons, NOT (s_acctbal < 0 OR s_nationkey % 5 = 0 OR s_name LIKE '%7') AS readable FROM {supplier}""",
    # OC1, OC6: lists by scope, and counts of each
    "resource_counts": """
        SELECT n_name, count(*) AS n_customers, isum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS n_degraded FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
    # OC11, OC12: first manifest of each slug; live ones first
    "catalog_listing": """
        WITH m AS (SELECT source AS slug, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {documents}), live AS (SELECT source AS slug, max(quality) AS live FROM {labels} JOIN {documents} USING (doc_id) GROUP BY source)
        SELECT m.slug, m.lang, coalesce(live, 0) = 1 AS is_live, row_number() OVER (ORDER BY coalesce(live, 0) DESC, m.slug) AS position FROM m LEFT JOIN live ON m.slug = live.slug WHERE r = 1""",
    # OC16: severity by ladder
    "turn_diagnosis": """
        SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'critical' WHEN role = 'assistant' AND length(text) < 40 THEN 'warning' WHEN length(text) > 1500 THEN 'notice' ELSE 'ok' END AS severity FROM {conversations}""",
    # OC17: stages as rows and as columns
    "turn_stage_table": """
        SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'system') AS n_system FROM {conversations} GROUP BY conv_id""",
}

PLANS |= {name.removesuffix("_all"): text for name, text in PLANS.items() if name.endswith("_all")}
QUERIES = {name: query_of(text) for name, text in PLANS.items()}
ORACLES = {name: check_of(text) for name, text in PLANS.items()}
