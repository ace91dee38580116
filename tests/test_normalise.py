"""Column functions against plain Python, by definition."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stratum.functions import normalise as n
from stratum.operators import sections as s

R = random.Random(11)


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


T = None


@pytest.fixture(autouse=True)
def text_column(spark):
    global T
    T = F.col("t")


def brute_paragraphs(text):
    whole = " ".join(text.split())
    parts = [p for p in re.split(r"(?<=[.!?])\s+", whole) if p]
    if not whole:
        return []
    if len(whole) < 210 or len(parts) < 2:
        return [whole]
    out, held, size = [], [], 0
    for p in parts:
        if held and (size + len(p) > 200 or len(held) >= 2):
            out.append(" ".join(held))
            held, size = [], 0
        held.append(p)
        size += len(p) + 1
    return out + [" ".join(held)]


def test_paragraphs_and_code(spark):
    words = lambda k: " ".join(R.choice(["alpha", "be", "gamma.", "delta!", "eps?"]) for _ in range(k))
    texts = ["", "  ", "short one.", "x" * 209, "x" * 210, "y" * 600, *[words(R.randint(1, 120)) for _ in range(40)]]
    assert [r[0] for r in values(spark, texts, n.paragraphs(T))] == [brute_paragraphs(t) for t in texts]
    codes = ["a\tb\r\n\n", "\n\n  x\t\ty  \n z\t", "abcd\te", "", "\tlead", "a\rb"]
    want = []
    for c in codes:
        lines = [x.rstrip() for x in c.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        want.append("\n".join(lines))
    assert [r[0] for r in values(spark, codes, n.clean_code(T))] == want


def test_prose_keeps_fences(spark):
    text = "One ,  two ( three )\nfour.\n\n[CODE language=\"sh\"]\n  oc  get\n\n  pods\n[/CODE]\nafter it\n \nlast [TABLE]\na | b\n[/TABLE]"
    ((got, blocks, kinds),) = values(spark, [text], n.prose_around_fences(T), n.block_texts(T), F.transform(n.block_texts(T), n.block_kind))
    code, table = '[CODE language="sh"]\n  oc  get\n\n  pods\n[/CODE]', "[TABLE]\na | b\n[/TABLE]"
    assert got == "\n\n".join(["One, two (three) four.", code, "after it", "last", table])
    assert blocks == ["One ,  two ( three )\nfour.", code, "after\u00a0it", "last", table]
    assert kinds == ["paragraph", "code", "paragraph", "paragraph", "table"]


@pytest.mark.parametrize("text, kind", [("Note: read", "note"), ("경고： x", "note"), ("Notes are", "paragraph"), ("1. a\n- b\n2. c", "procedure"), ("- b\n1. a", "paragraph"), ("1. a\nb", "paragraph"), ("Prerequisites: x, y", "prerequisite"), ("", "paragraph"), ("plain", "paragraph")])
def test_kinds_of_blocks(spark, text, kind):
    assert values(spark, [text], n.block_kind(T)) == [(kind,)]


def test_steps_attributes_and_anchors(spark):
    ((steps, attributes, anchors),) = values(spark, ["1. one\n- p\n* q\n3. three"], n.steps(T), n.marker_attributes(F.lit(' a="1 b" c_d="x" a="2"')), n.unique_anchors(F.array(*map(F.lit, ["a", "a", "b", "a", " "]))))
    assert [(x.ordinal, x.text, x.points) for x in steps] == [(1, "one", ["p", "q"]), (3, "three", [])]
    assert attributes == {"a": "2", "c_d": "x"} and anchors == ["a", "a-2", "b", "a-3", "section"]
    assert values(spark, ["# A *b*\ntext\n## [Link](u) `x`\n## A b"], n.markdown_anchors(T)) == [(["a-b", "link-x", "a-b-2"],)]


def brute_renumbered(text, identities):
    used = [int(x) for x in re.findall(r"\[(\d+)\]", text) if 1 <= int(x) <= len(identities)]
    if not used:
        return text, []
    kept, number = [], {}
    for x in used:
        same = [k for k in kept if identities[k - 1] == identities[x - 1]]
        if not same:
            kept.append(x)
        number[x] = (kept.index(same[0]) if same else len(kept) - 1) + 1
    text = re.sub(r"\[(\d+)\]", lambda m: f"[{number[int(m[1])]}]" if int(m[1]) in number else "", text)
    return re.sub(r"[ \t]+", " ", re.sub(r"(\[\d+\])(?:\s*\1)+", r"\1", text)).strip(" "), kept


def test_citations(spark):
    texts = ["[3] [1] [3]", "none", "a [2][2] b [9]", "[10] x", *[" ".join(R.choice(["w", "[1]", "[2]", "[3]", "[4]", "[7]"]) for _ in range(8)) for _ in range(30)]]
    identities = ["u", "v", "u", "w"]
    got = values(spark, texts, n.renumbered(T, F.array(*map(F.lit, identities))))
    assert [(r[0].text, r[0].kept) for r in got] == [brute_renumbered(t, identities) for t in texts]
    # marks are looked for once a row
    plan = spark.range(1).select(n.renumbered(F.col("id").cast("string"), F.array(F.lit("u"))).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert values(spark, ["x"], n.citation_identity(F.lit(" /V "), T, T), n.citation_identity(F.lit(None), F.lit("U"), F.lit("A")), n.section_core(F.lit("1.2.3. The  Part")), n.anchor_root(F.lit("Ab_c_d")), n.excerpt(F.lit(" a \n b "), 3)) == [("/v", "u#a", "the part", "ab", "a b")]


def test_queries_and_numbers(spark):
    row = values(
        spark, ["Scale to 3 pods? Then what do I see?"],
        n.appended_terms(F.lit("Pod log pod"), F.array(F.lit("LOG level"), F.lit("x"))), n.sub_queries(T), n.counts_in(T), n.contains_any(T, ["pods"]), n.clean_command(F.lit(" $ # oc get")), n.structured_keys(F.lit("Set App.io/Name=x and app.io/name=x")),
        n.rewritten(F.lit(" q "), ("topic", F.lit("t")), ("entity", F.lit(" "))), n.manifest_kind(F.lit("a: b\nkind: Pod\n"), "x"), n.manifest_kind(F.lit(""), "x"),
    )[0]
    assert row == ("Pod log LOG level x".replace(" LOG", ""), ["Scale to 3 pods? Then what do I see?", "Scale to 3 pods", "Then what do I see"], [3], True, "oc get", ["app.io/name=x"], "q | topic t", "pod", "x")
    row = values(spark, ["x"], n.round_score(F.lit(1.23456)), n.safe_rate(F.lit(1), F.lit(0)), n.ratio(F.lit(1), F.lit(0)), n.known_time(F.lit(" ")), n.http_time(F.lit("Tue, 15 Nov 1994 08:12:31 GMT")), n.http_time(F.lit("soon")), n.absent(F.lit("A  b"), F.array(F.lit("a B"), F.lit("c"))), n.unfenced_json(F.lit('so:\n```json\n{"a": 1}\n```')))[0]
    assert row[:7] == (1.2346, 1.0, 0.0, n.EPOCH, "1994-11-15T08:12:31Z", None, ["c"]) and json.loads(row[7]) == {"a": 1}
    assert values(spark, ["Use `oc get pods` or `x` or `$ oc get pods`"], n.inline_commands(T, ["oc"]), n.replaced_in_order(T, {"Use": "Try", "Try": "See"})) == [(["oc get pods"], "See `oc get pods` or `x` or `$ oc get pods`")]


PAGE = """<html><head><title>Guide | Site</title></head><body><nav>menu</nav><article><h1>The &lt;Guide&gt;</h1><p>Intro  text .</p>
<h2>Install</h2><p>Do this.</p><pre>a
 b</pre><h3>Deep</h3><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><h2>Install</h2><p>Again<br>here</p><h2>Legal Notice</h2><p>no</p><h2>Empty</h2></article><footer>f</footer></body></html>"""
WANT = [
    (1, 1, "The <Guide>", "overview", ["The <Guide>"], "Intro text."),
    (2, 2, "Install", "install", ["Install"], "Do this.\n\n[CODE]\na\n b\n[/CODE]"),
    (3, 3, "Deep", "deep", ["Install", "Deep"], "[TABLE]\nk | v\n1 | 2\n[/TABLE]"),
    (4, 2, "Install", "install-2", ["Install"], "Again here"),
]


def test_sections_of_a_page_and_what_follows(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    rows = s.sections(df, "page_id", s.marked_text(F.col("html")), s.page_title(F.col("html")))
    assert [tuple(r)[1:] for r in rows.filter("page_id = 1").orderBy("ordinal").collect()] == WANT
    assert rows.filter("page_id <> 1").count() == 0
    parts = s.blocks(rows, "page_id", "ordinal")
    assert [(r.ordinal, r.kind) for r in parts.orderBy("ordinal", "block").collect()] == [(1, "paragraph"), (2, "paragraph"), (2, "code"), (3, "table"), (4, "paragraph")]
    assert parts.filter("kind = 'table'").first().cells == [["k", "v"], ["1", "2"]]
    flat = s.section_rows(rows, parts, "page_id", [("overview", ["welcome"]), ("procedure", ["install"])])
    assert [(r.semantic_role, r.block_kinds) for r in flat.orderBy("ordinal").collect()] == [("unknown", ["paragraph"]), ("procedure", ["paragraph", "code"]), ("procedure", ["table"]), ("procedure", ["paragraph"])]
    books = s.manuals(flat, "page_id")
    (book,) = books.collect()
    assert book.section_count == 4 and book.anchor_map["install-2"] == "Install"
    assert {(r.anchor, r.flat_text) for r in s.manual_sections(books, "page_id").collect()} == {(r.anchor, r.flat_text) for r in flat.collect()}
    assert s.derived_sections(books, "page_id", F.lit("d"), "/v/").first().sections[0].viewer_path == "/v/d#overview"
    assert [r.chunk_type for r in s.search_rows(flat, "page_id").orderBy("chunk_id").collect()] == ["reference", "command", "procedure", "procedure"]


def test_markdown_and_asciidoc(spark):
    markdown = "# Guide\nIntro.\n## One\n```sh\n# no heading\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n### Two ##\ntext"
    asciidoc = ":name: Guide\n= {name}\nIntro.\n== One\n// comment\n----\n# no heading\n----\n|===\n|a |b\n|===\n=== Two\nsee link:http://x[the text]"
    df = spark.createDataFrame([(1, markdown, asciidoc)], "i int, m string, a string")
    want = [(1, 1, "T", "overview", ["T"], "Intro."), (2, 2, "One", "one", ["One"], "[CODE]\n# no heading\n[/CODE]\n\n[TABLE]\na | b"), (3, 3, "Two", "two", ["One", "Two"], "text")]
    got = [tuple(r)[1:] for r in s.sections(df, "i", s.marked_markdown(F.col("m")), F.lit("T")).orderBy("ordinal").collect()]
    assert [(*r[:5], r[5].split("\n1 |")[0].removesuffix("\n[/TABLE]")) for r in got] == want and "1 | 2" in got[1][5]
    got = [tuple(r)[1:] for r in s.sections(df, "i", s.marked_asciidoc(s.expanded_attributes(F.col("a"))), F.lit("T")).orderBy("ordinal").collect()]
    assert [(*r[:5], r[5].removesuffix("\n[/TABLE]")) for r in got] == [*want[:2], (3, 3, "Two", "two", ["One", "Two"], "see the text")]


def test_signals_of_a_text(spark):
    patterns = {"commands": r"(?m)^[ ]*(?:[$#][ ]*)?git[ ][^\n]+", "errors": r"\b[A-Z][a-z]+Error\b"}
    row = values(spark, ["$ git pull\nIt ended in a LockError, once more a LOCKError and LockError.\ngit pull"], *s.operational_signals(T, patterns))[0]
    assert row == (["git pull"], ["LockError"])


def test_long_texts_do_not_end_the_jvm(spark):
    """Repeated groups of a pattern recurse in Java unless they are possessive."""
    from stratum.operators import sections

    table = "| a | b |\n| - | - |\n" + "| 1 | 2 |\n" * 100_000
    df = spark.createDataFrame([("x" * 1_000_000, "\n" * 1_000_000 + "end", table, "1.2" * 50_000 + ". x", "$ " * 200_000 + "oc get", "[1] " * 100_000)], "value string, blank string, rows string, path string, command string, marks string")
    mark = F.concat(F.lit('language="'), "value", F.lit('" caption="b\\"c"'))
    out = df.select(
        n.marker_attributes(mark).alias("m"), n.clean_code(F.col("blank")).alias("c"), F.length(sections.marked_markdown(F.col("rows"))).alias("t"), F.length(n.section_core(F.col("path"))).alias("p"), n.clean_command(F.col("command")).alias("o"),
        n.trim_leading(F.concat(F.repeat(F.lit("Legal "), 100_000), F.lit("rest")), ["Legal"]).alias("l"), n.renumbered(F.col("marks"), F.array(F.lit("a")))["text"].alias("r"),
    ).first()
    assert len(out.m["language"]) == 1_000_000 and out.m["caption"] == 'b\\"c' and out.c == "end" and out.t > 500_000 and out.o == "oc get" and out.l == "rest" and out.r == "[1]"
