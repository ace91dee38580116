import json
import random

from pyspark.sql import functions as F

from stratum.operators import payloads as p
from stratum.operators import units as u

BLOCK = {"kind": None, "text": None, "caption": None, "title": None, "label": None, "items": None, "steps": None, "headers": None, "cells": None}
BOOK = f"book long, title string, sections array<struct<{u.SECTION}>>, extra string"


def block(**of):
    return {**BLOCK, **of}


def books():
    blocks = [
        block(kind="paragraph", text=" Hello  world "), block(kind="prerequisite", items=["a", " ", None, "b"]), block(kind="procedure", steps=[{"text": "one", "substeps": ["x", "y"]}, {"text": "two", "substeps": None}]),
        block(kind="code", text="ls", caption="cap"), block(kind="note", title="T", text="N"), block(kind="table", caption="c", headers=["h1", "h2"], cells=[["1", "2"], None, ["3"]]), block(kind="anchor", label="L"), block(kind="odd", text="left out"), block(),
    ]
    return [(1, "Title", [{"heading": "H", "path": ["A", "B"], "blocks": blocks}, {"heading": "", "path": None, "blocks": None}], "e"), (2, None, [], None), (3, " ", None, "f"), (4, "x", [{"heading": "z", "path": [], "blocks": []}], None)]


def test_units_have_addresses(spark):
    got = u.units(spark.createDataFrame(books(), BOOK), "book").orderBy("book", "section", "ordinal").collect()
    assert [(r.unit_id, r.text) for r in got if r.book == 1] == [
        ("doc.title", "Title"), ("s0.heading", "H"), ("s0.path.0", "A"), ("s0.path.1", "B"), ("s0.b0.paragraph", "Hello  world"), ("s0.b1.prerequisite.0", "a"), ("s0.b1.prerequisite.3", "b"),
        ("s0.b2.procedure.0.text", "one"), ("s0.b2.procedure.0.substep.0", "x"), ("s0.b2.procedure.0.substep.1", "y"), ("s0.b2.procedure.1.text", "two"), ("s0.b3.code.caption", "cap"), ("s0.b4.note.title", "T"), ("s0.b4.note.text", "N"),
        ("s0.b5.table.caption", "c"), ("s0.b5.table.header.0", "h1"), ("s0.b5.table.header.1", "h2"), ("s0.b5.table.cell.0.0", "1"), ("s0.b5.table.cell.0.1", "2"), ("s0.b5.table.cell.2.0", "3"), ("s0.b6.anchor.label", "L"),
    ]
    assert [(r.book, r.unit_id) for r in got if r.book != 1] == [(4, "doc.title"), (4, "s0.heading")]


def test_round_trip_and_partial_translations(spark):
    df = spark.createDataFrame(books(), BOOK)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    none = spark.createDataFrame([], "book long, unit_id string, text string")
    assert same(u.translated(df, none, "book"), df)
    marked = u.units(df, "book").select("book", "unit_id", F.concat(F.lit("<"), "unit_id", F.lit(">")).alias("text"))
    done = u.translated(df, marked, "book")
    assert {(r.unit_id, r.text) for r in u.units(done, "book").collect()} == {(r.unit_id, f"<{r.unit_id}>") for r in marked.collect()}
    back = u.units(df, "book").select("book", "unit_id", "text")
    assert {tuple(r) for r in u.units(u.translated(done, back, "book"), "book").select("book", "unit_id", "text").collect()} == {tuple(r) for r in back.collect()}
    some = spark.createDataFrame([(1, "s0.b2.procedure.0.substep.1", " Y "), (1, "s0.b5.table.cell.2.0", "  "), (1, "s9.heading", "q"), (7, "doc.title", "q"), (4, "doc.title", "a"), (4, "doc.title", "b"), (1, None, "q")], "book long, unit_id string, text string")
    part = {r.book: r for r in u.translated(df, some, "book").collect()}
    assert part[1].sections[0].blocks[2].steps[0].substeps == ["x", "Y"] and part[1].sections[0].blocks[5].cells == [["1", "2"], None, ["3"]] and part[1].sections[0].blocks[0].text == " Hello  world "
    assert part[4].title == "b" and part[1].extra == "e" and part[3].sections is None and part[2].sections == []


def test_states_and_approved_rows(spark):
    states = spark.createDataFrame([("en_only",), ("mixed",), ("translated_ko_draft",), ("approved_ko",), ("other",), (None,)], "status string").select("status", *u.translation_state(F.col("status"))).collect()
    assert [(r.stage, r.next_status, r.output_mode, r.requires_translation, r.requires_review, r.runtime_eligible) for r in states] == [
        ("en_only", "translated_ko_draft", "translation_required", True, False, False), ("mixed_review", "translated_ko_draft", "mixed_review", True, False, False), ("translated_ko_draft", "approved_ko", "draft_review", False, True, False),
        ("approved_ko", "approved_ko", "runtime", False, False, True), ("unknown", "other", "unknown", False, False, False), ("unknown", "blocked", "unknown", False, False, False),
    ]
    rows = spark.createDataFrame([("a", "old", 0.0, 1), ("a", "old", 0.5, 2), ("b", "old", None, 3)], "slug string, book_title string, trust_score double, n int")
    got = u.approved(rows, spark.createDataFrame([("a", "New", "s1")], "slug string, title string, source_id string"), "slug").orderBy("n").collect()
    assert [(r.n, r.book_title, r.source_id, r.trust_score, r.review_status) for r in got] == [(1, "New", "s1", 0.98, "approved"), (2, "New", "s1", 0.5, "approved")]


def payloads(spark, values):
    rows = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in enumerate(values)], "id long, text string")
    return p.walk(rows.select("id", F.parse_json("text").alias("payload")))


def random_value(r, depth):
    kind = r.choice(["o", "a", "s", "n", "z", "b"]) if depth < 6 else "s"
    if kind == "o":
        return {r.choice(["id", "k", "k\"q", "é", "drop", "a.b", ""]): random_value(r, depth + 1) for _ in range(r.randrange(4))}
    if kind == "a":
        return [random_value(r, depth + 1) for _ in range(r.randrange(13))]
    return {"s": r.choice(["x", "line\nend", "q\"\\", "", "/p/7/x"]), "n": r.randrange(-9, 99), "z": None, "b": r.random() < 0.5}[kind]


def cleaned(value):
    if isinstance(value, dict):
        return {k: cleaned(v) for k, v in value.items() if k != "drop"}
    return [cleaned(v) for v in value] if isinstance(value, list) else value


def test_any_shape_comes_back(spark):
    r = random.Random(3)
    values = [{"a": {"b": {"c": {"d": {"e": {"f": [1, {"g": None}]}}}}}}, [], {}, "s", 5, None, [[[]]], {"drop": 1}] + [random_value(r, 0) for _ in range(60)]
    nodes = payloads(spark, values)
    assert {x.id: json.loads(x.json) for x in p.nested(nodes).collect()} == dict(enumerate(values))
    assert {x.id: json.loads(x.json) for x in p.nested(p.without_fields(nodes, [("**", "drop")])).collect()} == {k: cleaned(v) for k, v in enumerate(values)}


def test_fields_and_values(spark):
    nodes = payloads(spark, [{"path": "x", "runtime": {"path": "y", "keep": 1}, "audit": {"deep": {"path": 2}}, "list": [{"path": 1}]}, {"audit": [1]}, {"runtime": 7}])
    got = lambda n: {x.id: json.loads(x.json) for x in p.nested(n).collect()}
    assert got(p.without_fields(nodes, [("path",), ("runtime", "path")])) == {0: {"runtime": {"keep": 1}, "audit": {"deep": {"path": 2}}, "list": [{"path": 1}]}, 1: {"audit": [1]}, 2: {"runtime": 7}}
    assert got(p.without_fields(nodes, [("**", "deep", "path")]))[0]["audit"] == {"deep": {}}
    assert got(p.only_fields(nodes, ["audit"])) == {0: {"audit": {"deep": {"path": 2}}}, 1: {"audit": [1]}, 2: {}}
    put = spark.createDataFrame([(0, [".runtime"], '"gone"'), (1, [".new"], "null"), (2, [".a", ".b"], "1")], "id long, path array<string>, json string")
    assert got(p.with_values(nodes, put)) == {0: {"path": "x", "runtime": "gone", "audit": {"deep": {"path": 2}}, "list": [{"path": 1}]}, 1: {"audit": [1], "new": None}, 2: {"runtime": 7}}


def test_ids_and_links(spark):
    nodes = payloads(spark, [{"draft_id": " d1::x ", "deep": [{"href": "/packs/d2/a", "n": {"draft_id": 7}}, "see", "/packs/d3/"], "selected": ["d4::q", "", None, {"selected": "d9"}], "x": None}, {"draft_id": None}, "/packs/d5/", None])
    got = p.linked_ids(nodes, ["draft_id"], ["selected"], [r"^/packs/([^/]+)/", r"[?&]draft_id=([^&]+)"]).collect()
    assert {(r.id, r.found) for r in got} == {(0, "d1"), (0, "d2"), (0, "7"), (0, "d3"), (0, "d4"), (2, "d5")}


def test_wanted_units_keep_their_ordinals_and_a_line_separator_is_no_blank(spark):
    """The space before a line separator at the end stays, as in SQL; units that aren't wanted are no rows."""
    block = "array(named_struct('kind', 'paragraph', 'text', ' a \\u2028', 'caption', cast(null AS string), 'title', cast(null AS string), 'label', cast(null AS string), 'items', cast(null AS array<string>), 'steps', cast(null AS array<struct<text string, substeps array<string>>>), 'headers', cast(null AS array<string>), 'cells', cast(null AS array<array<string>>)))"
    books = spark.sql(f"SELECT id, 't' AS title, array(named_struct('heading', 'h', 'path', array('p', 'q'), 'blocks', {block})) AS sections FROM VALUES (1L), (cast(null AS bigint)), (1L) AS v(id)")
    got = [tuple(x) for x in u.units(books.filter("id = 1").limit(1), "id", lambda x: x.endswith(".paragraph")).collect()]
    assert got == [(1, 0, 3, "s0.b0.paragraph", "a \u2028")]
    # rows of one id, and those without an id, stay books of their own
    done = u.translated(books, spark.createDataFrame([(1, "s0.heading", "H"), (1, "doc.title", "T")], "id long, unit_id string, text string"), "id").selectExpr("id", "title", "size(sections) AS n", "sections[0].heading AS heading").collect()
    assert sorted(map(tuple, done), key=str) == [(1, "T", 1, "H"), (1, "T", 1, "H"), (None, "t", 1, "h")]
