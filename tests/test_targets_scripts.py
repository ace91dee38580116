import random
import re

from pyspark.sql import functions as F

from stratum.functions import scripts as sc
from stratum.operators import targets as t


def test_runs_and_main_script(spark):
    rows = spark.createDataFrame([("Pod 로그를 v4.12에서 보기",), ("abc가나다",), ("ab가나다",), ("漢字カナ",), ("123",), (None,), ("Ünïx-Привет",)], "x string")
    got = rows.select(sc.script_runs(F.col("x")).alias("r"), sc.main_script(F.col("x")).alias("m"), sc.script_letters(F.col("x")).alias("n")).collect()
    assert [(p.script, p.run) for p in got[0].r] == [("latin", "Pod"), ("hangul", "로그를"), ("latin", "v"), ("digit", "4"), ("digit", "12"), ("hangul", "에서"), ("hangul", "보기")]
    assert [g.m for g in got] == ["hangul", "hangul", "hangul", "han", None, None, "cyrillic"]  # a tie goes to the first of the ladder
    assert got[1].n == {"latin": 3, "hangul": 3} and got[5].n == {}


def test_letters_counted_one_by_one(spark):
    signs = "aZéʯ0 9-_\n\x7f\x80×÷가ㄱ漢カЖΩ😀\u0000]^\\"
    texts = ["".join(random.Random(k).choices(signs, k=60)) for k in range(40)]
    count = lambda text, letters: sum(bool(re.match(f"[{letters}]", c)) for c in text)
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", sc.script_letters(F.col("x")).alias("n"), sc.main_script(F.col("x")).alias("m"))
    for r in got.collect():
        expected = {name: count(r.x, letters) for name, letters in sc.SCRIPTS.items()}
        assert r.n == {name: n for name, n in expected.items() if n}
        assert r.m == max((name for name in expected if name != "digit"), key=lambda name: expected[name])
    # the text is looked through by the scripts that have letters in ASCII, not by all
    told = spark.createDataFrame([("x",)], "x string").select(sc.main_script(F.col("x")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert told.count("coalesce(x#") == 2


def test_terms_for_a_query_in_hangul(spark):
    terms = ["로그", " Pod ", "backup", "etcd", "node name", "oc-adm", "x1", "", None, "plain", "ÀB", "in query"]
    row = spark.createDataFrame([("etcd 백업 IN  QUERY? in query", terms)], "q string, terms array<string>")
    assert row.select(sc.filtered_terms(F.col("q"), F.col("terms"), ["Backup"]).alias("t")).first().t == ["로그", "Pod", "backup", "etcd", "oc-adm", "x1", "ÀB", "in query"]


def test_headings_and_reference_books(spark):
    cases = {"1.2. Installing a cluster": True, "Chapter 3. Overview": True, "설치 overview": False, "2. oc get pods": False, "oc get pods": True, "console.flag/provider": False, "12.": False, None: False, "a.1 b": True, "kubectl is here (really)": True}
    rows = spark.createDataFrame([(k,) for k in cases], "h string")
    assert [r.e for r in rows.select(sc.counts_as_english(F.col("h")).alias("e")).collect()] == list(cases.values())
    # a single letter counts as a number, so that a command has to stand behind one
    slugs = spark.createDataFrame([("node_apis",), ("operators",), (" cli ",), (None,)], "s string")
    assert [r.r for r in slugs.select(sc.is_reference_heavy(F.col("s"), ["cli"]).alias("r")).collect()] == [True, False, True, False]


def test_overlay_targets(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    books = make([("net", "/b/net", "Networking", "s", 1), ("net", "/b/draft", "Draft", "s", 2), ("bare", None, None, None, 1)], "slug string, path string, title string, summary string, p int")
    entities = make([("etcd", "Etcd", "store")], "slug string, title string, summary string")
    sections = make([("net", "dns", "/b/net#dns", "DNS", None)], "book string, anchor string, href string, label string, summary string")
    figures = make([("net", "a.png", "/f/a", "", "alt text", "img/a.png")], "book string, asset string, path string, caption string, alt string, source string")
    keys = t.keys("book", books, F.col("slug"), None, F.col("path"), F.col("title"), F.col("summary"), F.col("p"))
    keys = keys.unionByName(t.keys("entity_hub", entities, F.col("slug"), None, F.lit(None), F.col("title"), F.col("summary")))
    keys = keys.unionByName(t.keys("section", sections, F.col("book"), F.col("anchor"), F.col("href"), F.col("label"), F.col("summary")))
    keys = keys.unionByName(t.keys("figure", figures, F.col("book"), F.col("asset"), F.col("path"), F.coalesce(F.nullif("caption", F.lit("")), "alt"), F.col("source")))
    cases = [
        ("book", "book:net", None, "net", "/b/net", "Networking", "found"), ("book", "book: bare ", " /own ", "bare", "/own", "Bare", "found"), ("book", "book:gone_book", "", "gone_book", "/books/gone_book", "Gone Book", "missing"),
        ("entity_hub", "entity:etcd", None, "", "/entities/etcd", "Etcd", "found"), ("section", "section:net#dns", None, "net", "/b/net#dns", "DNS", "found"), ("section", "section:net#gone", None, "net", "/books/net#gone", "gone", "missing"),
        ("section", "section:net", None, "", "", "section:net", "malformed"), ("figure", "figure:net:a.png", None, "net", "/f/a", "alt text", "found"), ("figure", "figure:net:b:c.png", None, "net", "/figures/net/b:c.png", "b:c.png", "missing"),
        ("figure", "book:net", "/v", "", "/v", "book:net", "malformed"), ("page", "page:x", None, "", "", "page:x", "unknown_kind"), ("book", None, None, "", "", "", "malformed"), (None, "book:net", None, "", "", "book:net", "unknown_kind"),
    ]
    rows = make([(k, *c[:3]) for k, c in enumerate(cases)], "n int, target_kind string, target_ref string, viewer_path string")
    got = t.resolved(rows, keys).orderBy("n").collect()
    assert [(r.target_book, r.target_path, r.target_title, r.target_state) for r in got] == [c[3:] for c in cases]
    assert t.resolved(rows.limit(0), keys).columns == [*rows.columns, "target_book", "target_path", "target_title", "target_summary", "target_state"]
