from pyspark.sql import functions as F

from stratum.operators import retrieve as rt


def plans(spark):
    rows = [(1, "What is etcd", None), (2, "it fails again", "the etcd pod"), (3, "How do I install it? How do I remove it?", ""), (4, "tell me of pizza", None), (5, None, None), (6, "locate the backup", None)]
    asked = spark.createDataFrame([(4, "food"), (6, "locator"), (6, "other")], "query_id long, intent string")
    return rt.plan(spark.createDataFrame(rows, "query_id long, query string, hint string"), asked, ["locator"], ["food"], r"^it\b")


def test_plans(spark):
    got = {r.query_id: r for r in plans(spark).collect()}
    assert {k: r.candidates for k, r in got.items()} == {1: 20, 2: 40, 3: 40, 4: 20, 5: 20, 6: 40}
    assert got[2].rewritten == "it fails again the etcd pod" and got[2].parts == ["it fails again", "it fails again the etcd pod"] and got[2].follow_up
    assert len(got[3].parts) == 3 and got[4].outside == "food" and got[1].outside is None and got[5].parts == []
    parts = rt.part_queries(plans(spark)).collect()
    assert {(r.query_id, r.sub) for r in parts} == {(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (6, 0)}
    assert next(list(r.terms) for r in parts if r.query_id == 1) == ["what", "is", "etcd"]
    assert rt.plan(spark.createDataFrame([(1, "a b", None)], "query_id long, query string, hint string")).first().candidates == 20


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, book string, rank int")


def test_budgets(spark):
    own = hits(spark, [(q, k, "b", k) for q in (1, 2, 4, 9) for k in range(1, 60)])
    counts = {r.query_id: r["count"] for r in rt.within_budget(own, plans(spark)).groupBy("query_id").count().collect()}
    assert counts == {1: 20, 2: 40}


def test_fused_diverse_and_traced(spark):
    words = hits(spark, [(1, 1, "a", 1), (1, 2, "a", 2), (1, 3, "b", 3), (1, 4, None, 4), (1, 9, "n", 5)])
    near = hits(spark, [(1, 3, "b", 1), (1, 5, "c", 2), (1, 1, "a", 12)])
    lists = {"words": (words, 100), "vector": (near, 115)}
    got = rt.fused(lists, F.expr("doc_id = 9"))
    points = lambda *ranked: sum(w * 1_000_000 // (60 + r) for w, r in ranked)
    want = {3: points((100, 3), (115, 1)) * 11, 1: points((100, 1), (115, 12)) * 10, 2: points((100, 2)) * 10, 5: points((115, 2)) * 10, 4: points((100, 4)) * 10}
    assert {r.doc_id: r.points for r in got.collect()} == want and 9 not in want
    assert [r.doc_id for r in got.orderBy("rank").collect()] == sorted(want, key=lambda d: -want[d])
    final = rt.diverse(got, 1, 3)
    assert [(r.doc_id, r.rank) for r in final.orderBy("rank").collect()] == [(3, 1), (1, 2), (5, 3)]
    trace = {r.query_id: r for r in rt.traced(plans(spark), {"words": words, "vector": near}, final, 3).collect()}
    one = trace[1]
    assert (one.n_words, one.n_vector, one.n_final, one.words_books, one.vector_books, one.final_books, one.overlap, one.support) == (5, 3, 3, ["a", "b"], ["b", "c"], ["b", "a", "c"], ["b"], "vector+words")
    assert (trace[4].n_words, trace[4].words_books, trace[4].overlap, trace[4].support, trace[4].outside) == (0, [], [], "none", "food") and len(trace) == 6
