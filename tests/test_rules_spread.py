from stratum.operators import rules as r

RULES = "rule string, ordinal int, intent string, field string, words array<string>, absent boolean, factor double, bonus double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_of_one_query_stay_spread(spark):
    hits = spark.range(1000).selectExpr("'en' AS query_id", "id AS doc_id", "concat('b', id % 3) AS book", "'' AS section", "'the text' AS text", "1.0D / (1 + id) AS score")
    asked = spark.createDataFrame([("en", "en")], "query_id string, intent string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = r.adjusted(hits, asked, spark.createDataFrame([("the", 1, "en", "text", ["the"], False, 2.0, None)], RULES))
        assert "SortMergeJoin" not in _plan(told) and "Exchange hashpartitioning" not in _plan(told)
        every = told.select("query_id", "doc_id", "book", "score")
        table = spark.createDataFrame([("b2", 1, "en", ["b2"], 3, True)], "rule string, ordinal int, intent string, books array<string>, reach int, rescue boolean")
        assert [tuple(x)[1:3] for x in r.rebalanced(r.ranked(every, 2), every, asked, table, 3).orderBy("rank").select("rank", "doc_id", "rule").collect()] == [(2, "b2"), (0, "b2"), (1, "b2")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert told.filter("score <> round(2.0D / (1 + doc_id), 8) OR fired[0] <> 'the'").count() == 0
