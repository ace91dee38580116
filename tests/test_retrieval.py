import math

from pyspark.sql import functions as F

from stratum.operators import retrieval as r


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_reciprocal_ranks_count_noise_that_is_dropped(spark):
    a = hits(spark, [(1, 9, 3.0, 1), (1, 1, 2.0, 2), (1, 2, 1.0, 3)])
    b = hits(spark, [(1, 1, 0.9, 1), (1, 3, 0.8, 2), (1, 9, 0.7, 3)])
    got = {x.doc_id: x.score for x in r.rrf({"a": (a, 1.0), "b": (b, 1.0)}, 10, noise=F.col("doc_id") == 9).collect()}
    assert got == {1: round(1 / 62 + 1 / 61, 8), 2: round(1 / 63, 8), 3: round(1 / 62, 8)}


def test_bm25_by_hand(spark):
    texts = ["red red blue", "blue", "green tea green", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, ["red", "blue", "red"])], "query_id long, terms array<string>")
    mean = 7 / 4
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, n, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    got = {x.doc_id: x.score for x in r.bm25(docs, queries, 10).collect()}
    assert got == {0: round(part(2, 3, 1) + part(1, 3, 2), 6), 1: round(part(1, 1, 2), 6)}


def test_diversify_caps_each_book(spark):
    rows = [(1, i, float(10 - i), "b" if i < 5 else "c", 0) for i in range(8)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, book string, rank int")
    assert [x.doc_id for x in r.diversify(df, 2, 3).orderBy("rank").collect()] == [0, 1, 5]


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} x") for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, ["w1", "w4"]), (2, ["x"])], "query_id long, terms array<string>")
    want, before = None, spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, r.bm25(docs.repartition(int(n)), queries, 5).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bm25_adds_up_where_documents_are(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 7}" for j in range(1, 6))) for k in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, [f"w{q % 7}", f"w{(q + 2) % 7}"]) for q in range(20)], "query_id long, terms array<string>")
    whole = [tuple(x) for x in r.bm25(docs, queries, 5).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(r, "PAIRS", 50)
    dealt = r.bm25(docs, queries, 5)
    assert [tuple(x) for x in dealt.orderBy("query_id", "rank").collect()] == whole and len(whole) == 100
    # scores of all queries and documents are not shuffled
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(query_id" in line and "doc_id" in line]


def test_queries_are_compared_in_slices(spark, monkeypatch):
    """However many queries meet a batch of vectors, few are compared with it at once, and their first hits are the same."""
    monkeypatch.setattr(r, "QUERY_SLICE", 3)
    vectors = spark.range(90).selectExpr("id AS vec_id", "transform(array(1, 2, 3, 5), p -> cast(sin(id * p) AS float)) AS embedding")
    queries = vectors.selectExpr("vec_id AS query_id", "embedding AS vector")
    own = lambda hits: sorted(tuple(x) for x in hits.select("query_id", "doc_id", "rank").collect())
    assert own(r.cosine_top_blocks(vectors, queries, 4)) == own(r.cosine_top(vectors, queries, 4))
