import hashlib
import json
import random
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stratum.functions import text as t
from stratum.operators import chunks, sections, upserts
from stratum.sources import sinks, tables

WORDS = lambda n: " ".join(["w"] * n)


def test_packing_by_hand():
    blocks = [WORDS(60), WORDS(60), WORDS(60), WORDS(200)]
    sizes = [len(c.split()) for c in chunks.packed(blocks)]
    assert sizes == [120, 120, 160, 40]
    assert chunks.packed(["", "  "]) == [] and chunks.packed(["a b"]) == ["a b"]


def brute_packed(blocks, size, overlap):
    """By definition, with lists and sums made anew at each block."""
    out, held, fresh = [], [], False
    for b in blocks:
        words = b.split()
        for i in range(0, len(words), size):
            unit = words[i : i + size] if len(words) > size else b.split()
            if held and sum(map(len, held)) + len(unit) > size:
                if fresh:
                    out.append([w for u in held for w in u])
                tail = []
                while held and sum(map(len, tail)) < overlap:
                    tail.insert(0, held.pop())
                held = tail if overlap and sum(map(len, tail)) + len(unit) <= size else []
            held.append(unit)
            fresh = True
    return out + [[w for u in held for w in u]] if held else out


def test_packing_against_brute_force(spark):
    r = random.Random(4)
    for _ in range(200):
        blocks = [WORDS(r.randint(0, 30)) for _ in range(r.randint(0, 12))]
        size, overlap = r.randint(1, 25), r.randint(0, 9)
        assert [len(c.split()) for c in chunks.packed(blocks, size, overlap)] == [len(c) for c in brute_packed(blocks, size, overlap)]
    text = "one two\n\n[CODE]\na\n\nb\n[/CODE]\nthree"
    got = chunks.chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), size=5, overlap=0).orderBy("ordinal").collect()
    assert [x.text for x in got] == ["one two", "[CODE]\na\n\nb\n[/CODE]\nthree"]


def test_pieces_of_a_text():
    assert chunks.pieces_of("short", 10) == ["short"] and chunks.pieces_of("", 3) == [""]
    assert chunks.pieces_of("aaaa bbbb\ncccc dddd", 12) == ["aaaa bbbb", "cccc dddd"]
    assert chunks.pieces_of("aaaabbbbcccc", 5) == ["aaaab", "bbbcc", "cc"]
    assert chunks.pieces_of("aaaa bbbb cccc", 9) == ["aaaa bbbb", "cccc"]


def test_text_functions(spark):
    df = spark.createDataFrame([("A > b > 1.2.3. Logging", " a\t b\n"), ("1.2", "x")], "p string, s string")
    got = df.select(t.strip_section_prefix(F.col("p")), t.collapse_spaces(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("Logging", "a b"), ("1.2", "x")]
    row = spark.range(1).select(t.uuid5(F.lit("été:1")), t.ordered_unique(F.array(F.lit("B"), F.lit(" a "), F.lit("b"), F.lit(""), F.lit("A"))), t.cpu_millicores(F.lit("250m")), t.memory_mib(F.lit("1Gi")), t.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))).first()
    assert tuple(row) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "été:1")), ["B", "a"], 250.0, 1024.0, 0.0)


def test_upserts_and_diff(spark):
    schema = "k int, v string"
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], schema), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], schema)
    assert sorted(map(tuple, upserts.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, None), (4, "d")]
    got = sorted((r.k, r.change, r.fields) for r in upserts.snapshot_diff(old, new, ["k"], ["v"]).collect())
    assert got == [(1, "removed", []), (2, "changed", ["v"]), (4, "added", [])]
    counts = upserts.missing_counts(old, ["k", "v"]).first()
    assert (counts.n_rows, counts.rows_missing_any, counts.missing_v) == (3, 1, 1)


def test_tolerant_json_and_grouped_overwrite(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": 1, "name": "a"}\n\n{bad\n{"id": 2}\n')
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    assert sorted(r.id for r in tables.json_lines(spark, str(tmp_path / "rows.jsonl"), schema).collect()) == [1, 2]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text(json.dumps({"id": 7, "name": "x"}))
    (docs / "b.txt").write_text("no")
    (row,) = tables.json_documents(spark, str(docs), schema).collect()
    assert row.id == 7 and row.path.endswith("a.json") and row.bytes > 5
    out = str(tmp_path / "out")
    sinks.overwrite_groups(spark.createDataFrame([("x", 1), ("y", 2)], "g string, v int"), out, "g")
    sinks.overwrite_groups(spark.createDataFrame([("y", 3)], "g string, v int"), out, "g")
    assert sorted((r.g, r.v) for r in spark.read.parquet(out).collect()) == [("x", 1), ("y", 3)]
    assert sinks.envelope(spark.createDataFrame([("x", 1), ("x", 2)], "g string, v int"), "g").first().asDict() == {"count": 2, "gs": ["x"]}


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "g string, v int")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    sinks.write_targets(df, one, two)
    for path in (one, two):
        assert sorted((r.g, r.v) for r in spark.read.json(path).collect()) == [("x", 1), ("y", 2)]
    table = str(tmp_path / "table")
    sinks.replace_all(df, table, "g")
    sinks.replace_all(df.filter("g = 'y'"), table, "g")
    assert [(r.g, r.v) for r in spark.read.parquet(table).collect()] == [("y", 2)]
    sinks.replace_all(df, table, "g")
    sinks.delete_groups(spark, table, "g", df.filter("g = 'x'"), str(tmp_path / "left"))
    assert [(r.g, r.v) for r in spark.read.parquet(str(tmp_path / "left")).collect()] == [("y", 2)]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\ntext\n")
    (row,) = tables.text_documents(spark, str(docs)).collect()
    assert row.text == "# A\ntext\n" and row.path.endswith("a.md")
    (row,) = tables.file_digests(spark, str(docs)).collect()
    assert row.sha256 == hashlib.sha256(b"# A\ntext\n").hexdigest() and row.bytes == 9
    log = spark.createDataFrame([(i, i % 2) for i in range(9)], "at int, ok int").withColumn("ok", F.col("ok") == 1)
    assert sorted(r["at"] for r in tables.last_rows(log, 2, "at").collect()) == [7, 8]
    assert [r["at"] for r in tables.first_usable(log.withColumn("k", F.lit("k")), "k", "at", "ok").collect()] == [1]


def test_several_and_nested_articles_and_references(spark):
    from stratum.operators import sections

    pages = {
        "<body><article>a</article><nav>n</nav><ARTICLE class=x>b</article>z</body>": "a\n\nb",
        "<article>a<article>b</article>c</article><p>after</p>": "abc",
        "<article>only</article>": "only", "<main>m</main><main>k": "m\n\nk", "<body>x</body>": "x", "none": "none",
        "<articles>no</articles><article>y</article>": "y",
    }
    got = spark.createDataFrame([(k,) for k in pages], "h string").select(sections.content_root(F.col("h")).alias("r")).collect()
    assert [r.r for r in got] == list(pages.values())
    texts = {"caf&#233; &#x2014; &#X1F600; &lt;&amp;lt;": "café — 😀 <&lt;", "&#0; &#xD800; &#9999999; &#; &#x;": "&#0; &#xD800; &#9999999; &#; &#x;", None: None}
    got = spark.createDataFrame([(k,) for k in texts], "t string").select(sections.unescaped(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == list(texts.values())


def test_pages_are_cut_into_sections_once(spark):
    """Preambles and the other sections read one staged table, none marks the pages up again."""
    pages = spark.createDataFrame([(1, "<article><h1>T</h1><p>a</p><h2>B</h2><p>b</p></article>")], "page_id long, html string")
    out = sections.sections(pages, "page_id", sections.marked_text(F.col("html")), sections.page_title(F.col("html")))
    files = out.inputFiles()
    assert files and all("/sections-" in f for f in files)
    assert [(x.ordinal, x.heading, x.text) for x in out.orderBy("ordinal").collect()] == [(1, "T", "a"), (2, "B", "b")]
