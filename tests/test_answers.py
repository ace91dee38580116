from stratum.operators import answers as a

CITATION = "query_id long, ordinal int, book string, identity string, text string"


def cited(spark, rows):
    return spark.createDataFrame(rows, CITATION)


def test_fallback(spark):
    rows = cited(spark, [(1, 1, "a", "x", None), (1, 2, "a", "x", None), (1, 3, "b", None, None), (1, 4, "b", None, None), (1, 5, "c", "y", None), (1, 6, "d", "z", None), (2, 9, "a", "x", None)])
    assert [(r.query_id, r["index"], r.ordinal) for r in a.fallback_citations(rows).orderBy("query_id", "index").collect()] == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 9)]


def test_pruning_never_leaves_none(spark):
    rows = cited(spark, [(q, k, b, b, None) for q in (1, 2, 3, 4) for k, b in enumerate(["cfg", "ops", "cli", None])])
    asked = spark.createDataFrame([(1, "i"), (1, "j"), (2, "k"), (3, "j"), (3, "i")], "query_id long, intent string")
    rules = spark.createDataFrame([(1, "i", [["none"], ["ops", "cli"]]), (2, "j", [["cli", "cfg"]]), (3, "k", [["gone"]])], "ordinal int, intent string, tiers array<array<string>>")
    got = {}
    for r in a.pruned_citations(rows, asked, rules).collect():
        got.setdefault(r.query_id, set()).add(r.book)
    assert got == {1: {"cli"}, 2: {"cfg", "ops", "cli", None}, 3: {"cli"}, 4: {"cfg", "ops", "cli", None}}


def test_grounding(spark):
    queries = spark.createDataFrame([(1, "Run  git  log and see the DISK"), (2, "see the disk, but only logs"), (3, "git log"), (4, "anything"), (5, None)], "query_id long, query string")
    rows = cited(spark, [(1, 1, "b", "x", "First `GIT LOG`."), (1, 2, "b", "y", "then df -h"), (2, 1, "b", "x", "nothing"), (3, 1, "b", "x", "git push"), (5, 1, "b", "x", None)])
    rules = spark.createDataFrame([("disk", "disk", None, ["DF -h", "lsblk"]), ("logs", r"\blogs?\b", "git", ["journal"])], "rule string, asks string, unless string, any_of array<string>")
    got = {r.query_id: (list(r.commands), list(r.missing), r.grounded) for r in a.grounded(queries, rows, rules, r"git\s+[a-z]+").collect()}
    assert got == {1: (["git log"], [], True), 2: ([], ["disk", "logs"], False), 3: (["git log"], ["command"], False), 4: ([], ["citation"], False), 5: ([], [], True)}


def test_recent_targets(spark):
    refs = ["book:a", "section:b#x", "figure:a:p", "entity:e", "figure:c", "page:z", "plain", "section: a #y", None, "book:"]
    rows = [("u", r, 100 - k, k) for k, r in enumerate(refs)] + [("u", "book:late", 1, 99)] + [("v", f"book:v{k}", k, k) for k in range(20)]
    got = {}
    for r in a.recent_preferences(spark.createDataFrame(rows, "user_id string, target_ref string, updated long, id long")).collect():
        got.setdefault(r.user_id, {})[r.kind, r.name] = r.score
    assert got["u"] == {("book", "a"): 80, ("book", "b"): 66, ("entity", "e"): 62, ("book", "late"): 20}
    assert got["v"] == {("book", f"v{19 - k}"): max(10, 80 - 6 * k) for k in range(12)}
