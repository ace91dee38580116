"""Queries over whole tables, where others by these names take some of the rows."""

import os

import pytest

import __spark_entry__ as entry
from stratum.operators import retrieval


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    # 300 documents of three books; book c stands in no id that a filter takes, and its texts differ after 40 characters
    docs = [(i, "x" * 40 + str(i // 2), "de" if i % 11 == 5 else "en", "c" if i % 11 == 5 or i % 11 == 6 else "ab"[i % 2], 42) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality long, toxic long").write.parquet(os.path.join(path, "labels.parquet"))
    vectors = [(i, [float(i % 7), float(i % 5 - 2), 1.0]) for i in range(299)] + [(300, [0.0, 0.0, 0.0]), (301, None), (302, [1.0]), (303, [None, 1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(os.path.join(path, "embeddings.parquet"))
    words = "one two three four five six " + "x" * 40 + "7"
    spark.createDataFrame([(0, words), (1, words)], "item_id long, text string").write.parquet(os.path.join(path, "benchmark.parquet"))
    return path


def rows(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_all_documents_count(spark, folder):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    of = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    assert {r.doc_id for r in rows(spark, folder, "graph_boost_all")} == set(range(300))
    assert {r.source: r.n for r in rows(spark, folder, "citation_truth_all")} == of
    assert {r.source: (r.n_docs, r.n_labels) for r in rows(spark, folder, "corpus_dashboard_full_outer_all")} == {s: (n, n) for s, n in of.items()}
    assert {r.slug: (r.n, r.listed) for r in rows(spark, folder, "book_index_all")} == {s: (n, True) for s, n in of.items()}


def test_siblings_outside_a_filter_are_found(spark, folder):
    assert {(r.source, r.lang): r.state for r in rows(spark, folder, "source_state_reconcile_all")}[("c", "en")] == "en_with_sibling"


def test_texts_that_differ_late_are_others(spark, folder):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    assert len(rows(spark, folder, "citation_dedupe_all")) == docs.select("source", "text").distinct().count()


def test_each_stated_vector_asks(spark, folder):
    vectors = spark.read.parquet(os.path.join(folder, "embeddings.parquet"))
    queries = vectors.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    got = sorted(tuple(r) for r in rows(spark, folder, "cosine_topk_all"))
    assert {r[0] for r in got} == {0, 100, 200}
    assert got == sorted(tuple(r) for r in retrieval.cosine_top(vectors, queries, 20).collect())


def test_words_after_the_sixth_count(spark, folder):
    assert {(r.query_id, r.doc_id) for r in rows(spark, folder, "bm25_batch_all")} == {(q, d) for q in (0, 1) for d in (14, 15)}


def test_each_query_has_its_own_fused_list(spark, folder):
    found = {q: {r.doc_id for r in rows(spark, folder, "rrf_merge_all") if r.query_id == q} for q in (0, 100, 200)}
    assert all({14, 15} <= found[q] for q in (0, 100)) and found[200]
    for name in ("hybrid_fusion_weighted_all", "diversify_cap_per_source_all"):
        got = rows(spark, folder, name)
        assert {r.query_id for r in got} == {0, 100, 200}
        one = {q: sorted((r["rank"], r.doc_id) for r in got if r.query_id == q) for q in (0, 200)}
        assert [n for n, _ in one[200]] == list(range(1, len(one[200]) + 1)) and one[0] != one[200]
