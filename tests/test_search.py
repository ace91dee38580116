import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratum.functions.text import token_arrays, tokens
from stratum.operators import search as s

R = random.Random(7)


def texts(n):
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    return [" ".join([R.choice(common) for _ in range(R.randrange(60))] + [R.choice(rare) for _ in range(R.randrange(3))]) for _ in range(n)] + [None, ""]


def exhaustive(docs, queries, k):
    bags = {i: Counter((t or "").split()) for i, t in docs}
    mean = max(1.0, sum(sum(b.values()) for b in bags.values()) / len(bags))
    df = Counter(t for b in bags.values() for t in b)
    out = set()
    for q, sub, terms in queries:
        scores = {}
        for i, b in bags.items():
            n = sum(b.values())
            part = sum(math.log1p((len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * n / mean)) for t in sorted({t for t in terms if t}) if b[t])
            if part > 0:
                scores[i] = math.floor(part * 1e6 + 0.5) / 1e6
        out |= {(q, sub, i, scores[i], n + 1) for n, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k])}
    return out


def tables(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, sub long, terms array<string>")


@pytest.mark.parametrize("block, together", [(512, 4096), (8, 2)])
def test_as_if_all_were_scored(spark, monkeypatch, block, together):
    monkeypatch.setattr(s, "BLOCK", block)
    monkeypatch.setattr(s, "TOGETHER", together)
    docs = list(enumerate(texts(300)))
    queries = [(q, u, [R.choice(["c1", "c2", "r3", "r5", "r9", "nowhere", None]) for _ in range(R.randrange(1, 6))]) for q in range(6) for u in range(3)] + [(9, 0, ["r3", "r3"]), (10, 0, []), (11, 0, None)]
    d, q = tables(spark, docs, queries)
    got = s.search(s.index(d.repartition(3)), q, 5).collect()
    assert {tuple(r) for r in got} == exhaustive(docs, [x for x in queries if x[2]], 5) and len({r[:3] for r in map(tuple, got)}) == len(got)


def test_bounds_hold_and_rule_out_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 16)
    docs = [(i, "c1 " * 30 + f"w{i}") for i in range(400)] + [(1000 + i, "r1 r1 r1") for i in range(12)]
    d, q = tables(spark, docs, [(1, 0, ["r1", "c1"])])
    postings = s.index(d.coalesce(1))
    lists, bounds, _ = s.plan_blocks(postings, q)
    best = exhaustive(docs, [(1, 0, ["r1", "c1"])], 10)
    kth = min(score for *_, score, _ in best)
    assert bounds.count() > 20 and bounds.filter(F.col("bound") >= kth).count() <= 2  # two blocks of 27 are read
    assert {tuple(r) for r in s.search(postings, q, 10).collect()} == best
    top = {r.doc_id: r.score for r in s.search(postings, q, 500).collect()}
    of = {i: (r.block, top.get(i, 0)) for r in postings.filter("term IS NULL").collect() for i in r.ids}
    limit = {r.block: r.bound for r in bounds.collect()}
    assert all(score <= limit[b] + 1e-6 for b, score in of.values() if score)


def test_no_rows(spark):
    d, q = tables(spark, [(1, "a b")], [(1, 0, ["a"])])
    assert s.search(s.index(d.limit(0)), q, 3).collect() == []
    assert s.search(s.index(d), q.limit(0), 3).collect() == []
    assert [r.doc_id for r in s.search(s.index(spark.createDataFrame([(None, "a"), (2, "A")], d.schema)), q, 3).collect()] == [2]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, sub long, doc_id long, book string, rank int, score double")


def test_two_levels(spark):
    core = hits(spark, [(1, 0, 10, "b", 1, 9.0), (1, 0, 11, "a", 2, 8.0), (1, 1, 11, "a", 1, 7.0), (2, 0, 10, "b", 1, 1.0), (1, 1, 99, "z", 2, 1.0)])
    over = hits(spark, [(1, 0, 20, "u", 1, 1.0), (1, 1, 20, "u", 1, 1.0), (1, 0, 11, "a", 2, 1.0)])
    got = {(r.query_id, r.doc_id): r for r in s.multi_search(core, over, 10, noise=F.expr("doc_id = 99")).collect()}
    assert {q: [d for (p, d), r in sorted(got.items(), key=lambda x: x[1].rank) if p == q] for q in (1, 2)} == {1: [11, 20, 10], 2: [10]}
    # in the core list 11 (1/62 + 1/61) is before 10 (1/61); in the overlay 20 (2/61) is before 11 (1/62)
    assert got[1, 11].score == round(1 / 61 + 1.35 / 62, 8) and got[1, 20].score == round(1.35 / 61, 8) and got[1, 10].score == round(1 / 62, 8)
    assert got[2, 10].score == round(1 / 61, 8)  # no overlay: the core list as it is
    alone = s.multi_search(core, None, 1).collect()
    assert {(r.query_id, r.doc_id, r.rank) for r in alone} == {(1, 11, 1), (2, 10, 1)}


def test_ties_by_book_then_id(spark):
    got = s.multi_search(hits(spark, [(1, 0, 5, "b", 1, 1.0), (1, 1, 4, "b", 1, 1.0), (1, 2, 9, "a", 1, 1.0), (1, 3, 3, None, 1, 1.0)]), None, 9).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [3, 9, 4, 5]


def test_vectors_of_sub_queries(spark):
    official = hits(spark, [(1, 0, 1, "a", 1, 0.9), (1, 1, 2, "a", 1, 0.9)])
    private = hits(spark, [(1, 0, 7, "p", 1, 0.8), (2, 0, 8, "p", 1, 0.8)])
    got = {(r.query_id, r.doc_id): r.score for r in s.multi_vector_search(official, private, 5).collect()}
    # in sub-query 0 the private hit, of more weight, comes first; the others have one list each
    assert got == {(1, 7): round(1 / 61, 8), (1, 1): round(1 / 62, 8), (1, 2): round(1 / 61, 8), (2, 8): round(1 / 61, 8)}


def test_selection(spark):
    rows = hits(spark, [(1, 0, 1, "a", 1, 1.0), (1, 0, 2, "b", 2, 1.0), (2, 0, 1, "a", 1, 1.0), (3, 0, 1, "a", 1, 1.0), (4, 0, 1, "a", 1, 1.0)]).withColumn("draft", F.col("book"))
    contexts = spark.createDataFrame([(1, True, [" a "]), (2, True, None), (3, False, ["b"])], "query_id long, restricted boolean, selected array<string>")
    assert {(r.query_id, r.doc_id) for r in s.of_selection(rows, contexts).collect()} == {(1, 1), (3, 1), (4, 1)}


def test_tokens_inside_tasks(spark):
    """Tokens that are cut in a task are those of tokens(): F22."""
    odd = ["", None, "Ab-c.d_E 9", "가나다abc힣x", "꿿ZKkİi ſıK", "꯿가힤힣ힰ", "é가é", "가", "한 글", "ꀀ꯰ퟻ", "a\x00b\nc\td", "😀a😀가", "日本語 Straße", "-._", "가 가́A", "A" * 3000]
    odd += ["".join(R.choice("aZ09_.- \n가힣각Kİé日😀힤꯿") for _ in range(R.randrange(40))) for _ in range(300)]
    want = [list(r[0]) if r[0] is not None else [] for r in spark.createDataFrame([(t,) for t in odd], "text string").coalesce(1).select(tokens(F.col("text"))).collect()]
    for at, size in ((0, len(odd)), (3, 50), (0, 0)):  # slices have offsets of their own
        found, n = token_arrays(pa.array(["before", *odd], pa.string()).slice(at + 1, size))
        got, ends = found.to_pylist(), [0, *n.cumsum().tolist()]
        assert [got[i:j] for i, j in zip(ends, ends[1:])] == want[at : at + size]
    # broken characters part tokens, and none is made of two texts
    broken = pa.array([b"a\xea\xb0", b"\x80b", b"\xf0\xea\xb0\x80c"], pa.binary())
    found, n = token_arrays(pa.StringArray.from_buffers(3, broken.buffers()[1], broken.buffers()[2]))
    assert found.to_pylist() == ["a", "b", "가", "c"] and n.tolist() == [1, 1, 2]


@pytest.mark.parametrize("added", [4096, 3])
def test_index_of_asked_terms(spark, monkeypatch, added):
    """An index that is made for queries has their terms alone, and gives the same hits: F22."""
    monkeypatch.setattr(s, "BLOCK", 16)
    monkeypatch.setattr(s, "ADDED", added)
    docs = list(enumerate(texts(200)))
    queries = [(q, u, [R.choice(["c1", "c2", "c7", "r3", "r5", "nowhere", None]) for _ in range(8)]) for q in range(5) for u in range(4)] + [(7, 0, None), (8, 0, [])]
    d, q = tables(spark, docs, queries)
    postings = s.index(d.repartition(2), q)
    assert {r.term for r in postings.select("term").distinct().collect()} <= {None, "c1", "c2", "c7", "r3", "r5"}
    assert postings.filter("term IS NULL").agg(F.sum(F.size("ids"))).first()[0] == len(docs)
    assert {tuple(r) for r in s.search(postings, q, 6).collect()} == exhaustive(docs, [x for x in queries if x[2]], 6)


def test_parts_of_a_block_are_made_once(spark):
    """A block's postings get their weights with them: sub-queries are sent with their terms alone, however many there are: F22."""
    d, q = tables(spark, list(enumerate(texts(50))), [(k, 0, ["c1", "r3"]) for k in range(9)])
    lists, _, only = s.plan_blocks(s.index(d, q), q)
    assert dict(lists.dtypes)["terms"] == "array<string>" and {"idf", "mean"} <= set(only.columns)
    assert lists.count() == 9 and only.filter("term IS NOT NULL AND idf IS NULL").count() == 0
