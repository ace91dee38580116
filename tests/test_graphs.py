import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from stratum.operators import graphs as g
from stratum.operators.retrieval import FREED, kept

R = random.Random(9)
CHUNK = "book string, chunk long, commands array<string>, objects array<string>"


def chunks():
    out = [(f"b{R.randrange(30)}", k, R.sample(["oc get", " OC  get", "etcd", "x", "", None], 3), [f"o{R.randrange(12)}" for _ in range(3)]) for k in range(150)]
    return out + [(None, 900, ["x"], []), ("", 901, ["x"], []), ("b1", None, ["x"], []), ("lonely", 902, None, ["only"])]


def expected(rows):
    by = {}
    for book, chunk, *lists in rows:
        for kind, values in zip(("command", "object"), lists):
            for v in values or []:
                if v and v.strip() and book and chunk is not None:
                    by.setdefault((kind, " ".join(v.lower().split())), set()).add((book, chunk))
    pairs = {}
    for (kind, _), members in by.items():
        n = {}
        for book, _ in members:
            n[book] = n.get(book, 0) + 1
        for a, b in combinations(sorted(n), 2):
            shared, total = pairs.get((a, b, kind), (0, 0))
            pairs[a, b, kind] = shared + 1, total + n[a] + n[b]
    return {k: (len(m), len({b for b, _ in m})) for k, m in by.items() if len(m) > 1}, {(*k, *v) for k, v in pairs.items()}


@pytest.mark.parametrize("block", [512, 4])
def test_hyperedges_and_pairs(spark, block):
    rows = chunks()
    signals = g.chunk_signals(spark.createDataFrame(rows, CHUNK), {"command": "commands", "object": "objects"})
    edges, pairs = expected(rows)
    assert {(r.kind, r.value): (r.n_chunks, r.n_books) for r in g.hyperedges(signals).collect()} == edges
    got = [tuple(r) for r in g.book_pairs(signals, block).select("a", "b", "kind", "shared", "chunks").collect()]
    assert set(got) == pairs and len(got) == len(pairs)


def test_full_and_compact_agree(spark):
    rows = chunks()
    signals = g.chunk_signals(spark.createDataFrame(rows, CHUNK), {"command": "commands", "object": "objects"})
    hyper, pairs = g.hyperedges(signals), g.book_pairs(signals)
    books = spark.createDataFrame([("b1", "One"), ("b1", "Uno"), ("empty", "No chunks")], "book string, title string")
    derived = spark.createDataFrame([("b1", "b2"), ("b1", "gone"), ("b2", "b2"), ("", "b1")], "book string, origin string")
    nodes, edges = g.vertices(books, signals, hyper), g.edges_of(signals, hyper, pairs, derived)
    assert nodes.count() == nodes.select("id").distinct().count()
    assert {r.id: r.title for r in nodes.collect()}["book:b1"] == "One" and nodes.filter("id = 'book:empty'").count() == 1
    assert [(r.source, r.missing) for r in g.dangling(edges, nodes).collect()] == [("book:b1", "book:gone")]
    told = {r.measure: r.n for r in g.summary(nodes, edges).collect()}
    assert told["dangling"] == 1 and told["edges:derived"] == 2 and told["vertices:signal"] == hyper.count()
    related = {(r.source[5:], r.target[5:]): r.weight for r in edges.filter("type = 'related'").collect()}
    small = {r.book: [(x.other, x.weight) for x in r.relations] for r in g.compact(pairs, edges, 3).collect()}
    for book, relations in small.items():
        own = sorted(((-w, b if a == book else a) for (a, b), w in related.items() if book in (a, b)))[:3]
        assert relations == [(other, -w) for w, other in own]
    assert set(small) == {x for pair in related for x in pair}


@pytest.mark.parametrize("block, entries", [(512, 1 << 27), (4, 2000)])
def test_relations_in_rounds(spark, block, entries, monkeypatch):
    monkeypatch.setattr(g, "ROUND_SHARE", 0)
    signals = g.chunk_signals(spark.createDataFrame(chunks(), CHUNK), {"command": "commands", "object": "objects"}).localCheckpoint()
    pairs = g.book_pairs(signals).localCheckpoint()
    told = lambda df: {r.book: [(x.other, x.weight) for x in r.relations] for r in df.collect()}
    assert told(g.related_first(signals, 3, block, entries)) == told(g.compact(pairs, g.edges_of(signals, g.hyperedges(signals), pairs), 3))
    assert g.related_count(signals, block, entries).first().n == pairs.select("a", "b").distinct().count()
    assert (len(list(g.related(signals, g.numbered(signals), block, entries))) > 1) == (entries == 2000)


def test_signals_without_pairs(spark):
    signals = g.chunk_signals(spark.createDataFrame([("b", 1, ["x"], [])], CHUNK), {"command": "commands", "object": "objects"})
    assert g.related_first(signals).count() == 0 and g.related_count(signals).first().n == 0


def test_shuffles_end_with_the_table_they_make(spark):
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    setting, first = spark.conf.get(FREED, "false"), spark.sparkContext._jsc.sc().newShuffleId()
    assert kept(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "freed").schema.names == ["k", "count"]
    made = range(first + 1, spark.sparkContext._jsc.sc().newShuffleId())
    assert len(made) > 0 and not any(known.containsShuffle(k) for k in made) and spark.conf.get(FREED, "false") == setting


FIELDS = {"command": "commands", "object": "objects"}


@pytest.mark.parametrize("block, ordered", [(512, False), (4, True)])
def test_counts_are_those_of_the_tables(spark, block, ordered):
    rows = chunks() + [("b1", 3, ["x"], ["o1"])]
    frame = spark.createDataFrame([*rows, *rows[:20]], CHUNK)
    books = spark.createDataFrame([("b1", "One"), ("empty", "No chunks"), ("", "None")], "book string, title string")
    derived = spark.createDataFrame([("b1", "b2"), ("b1", "b2"), ("b1", "gone"), ("lost", "gone"), ("b2", "b2"), ("", "b1")], "book string, origin string")
    signals = g.chunk_signals(frame, FIELDS).localCheckpoint()
    hyper = g.hyperedges(signals)
    edges = g.edges_of(signals, hyper, g.book_pairs(signals), derived)
    told = {r.measure: r.n for r in g.summary(g.vertices(books.filter("book <> ''"), signals, hyper), edges).collect()}
    numbered = g.numbered_signals(frame, FIELDS, ordered).localCheckpoint()
    assert {r.measure: r.n for r in g.counted(numbered, books, derived, block).collect()} == told and told["dangling"] == 3
    assert {tuple(r) for r in numbered.select("book", "chunk", "kind", "value").collect()} == {tuple(r) for r in signals.select("book", "chunk", "kind", "value").collect()}
    ids = numbered.select("id", "book").distinct().orderBy("id").collect()
    assert len({r.id for r in ids}) == len({r.book for r in ids}) == len(ids) and (not ordered or [r.book for r in ids] == sorted(r.book for r in ids))


def test_pairs_are_dealt_once(spark):
    """Lists that count pairs go to the lesser book alone: half as many entries, a row a list and book."""
    signals = g.chunk_signals(spark.createDataFrame(chunks(), CHUNK), FIELDS).localCheckpoint()
    entries = lambda both: sum(len(r.others) for dealt in g.related(signals, g.numbered(signals), both=both) for r in dealt.collect())
    sizes = [n for _, n in expected(chunks_of(signals))[0].values() if n > 1]
    assert entries(True) == sum(n * n for n in sizes) and entries(False) == sum(n * (n - 1) // 2 for n in sizes)


def chunks_of(signals):
    return [(r.book, r.chunk, [r.value] if r.kind == "command" else [], [r.value] if r.kind == "object" else []) for r in signals.collect()]


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
@pytest.mark.parametrize("far", [1, 1 << 59])
def test_books_are_weighed_whole_however_rows_come(span, far):
    r = random.Random(span)
    rows = [(0, [r.randrange(9) * far for _ in range(r.randrange(6))]) for _ in range(40)] + [(7 + i, [r.randrange(9) * far for _ in range(r.randrange(6))]) for i in range(5) for _ in range(3)]
    batches = [pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array([o for _, o in part], pa.list_(pa.int64()))], names=["id", "others"]) for part in (rows[k : k + 4] for k in range(0, len(rows), 4))]
    got = [(int(own[a]), int(o), int(w)) for own, at, other, weight in g._weighed(batches, span) for a, o, w in zip(at, other, weight)]
    assert got == sorted((i, o, n) for (i, o), n in Counter((i, o) for i, others in rows for o in others).items())


def test_signals_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(g, "ROWS", 4)
    rows = [(1, s, i, c, 1) for s, i, c in [("a", 5, 1), ("b", 5, 1), ("a", 3, 2), ("b", 9, 4), ("a", 5, 7), ("a", 5, 1)]] + [(2, "a", k % 2, 0, 2) for k in range(30)] + [(3, "c", 8, 8, 1)]
    batch = lambda part: pa.record_batch([pa.array(x) for x in zip(*part)], names=["h", "signal", "id", "chunk", "blocks"])
    got = [tuple(r.values()) for out in g._lists(iter([batch(rows[:3]), batch(rows[3:20]), batch(rows[20:])])) for r in out.to_pylist()]
    assert sorted(got) == [("a", 1, 3, [3, 5]), ("a", 2, 2, [0, 1]), ("b", 1, 2, [5, 9]), ("c", 1, 1, [8])]


def test_first_relations_come_without_a_sort_by_place():
    lists = pa.record_batch([pa.array([1, 1, 2]), pa.array([[1, 5, 3, 9], [9, 1, 4], [7, 2]])], names=["id", "others"])
    first = [tuple(r.values()) for out in g._first(3)(iter([lists])) for r in out.to_pylist()]
    assert first == [(1, 1, 9, 2), (1, 2, 3, 1), (1, 3, 4, 1), (2, 1, 7, 1)]
    rows = [(1, 2, "c", 1), (1, 0, "own", 0), (1, 1, "i", 2), (2, 0, "two", 0), (3, 0, "three", 0), (3, 1, "g", 1)]
    batch = pa.record_batch([pa.array(x) for x in zip(*rows)], names=["id", "place", "name", "weight"])
    got = [r for out in g._rows_of_books(iter([batch])) for r in out.to_pylist()]
    assert [(r["book"], [(x["other"], x["weight"]) for x in r["relations"]]) for r in got] == [("own", [("i", 2), ("c", 1)]), ("three", [("g", 1)])]
