import hashlib
import random

import numpy as np

from stratum.llm import repeats as r

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string"
R = random.Random(3)


def brute(data):
    texts = [(i, (t or "").encode()) for i, t in data]
    first = {}
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                first[s] = min(i, first.get(s, i))
    out = set()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.add((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(n):
    return " ".join("".join(R.choices("abcdeé ", k=R.randint(1, 9))) for _ in range(n))


def corpus():
    passages = [words(R.randint(8, 60)) for _ in range(6)] + ["é" * 40, "ab" * 60, "x" * 49, "y" * 50]
    texts = []
    for _ in range(90):
        parts = [words(R.randint(0, 12)) for _ in range(R.randint(1, 4))]
        for _ in range(R.choice([0, 1, 1, 2, 3])):
            p = R.choice(passages)
            a = R.randrange(len(p))
            parts.insert(R.randrange(len(parts) + 1), R.choice([p, p[a:], p[:a], p + p]))
        texts.append("".join(parts))
    texts += [texts[4], texts[4], texts[9] + texts[4], "", None, "short", "z" * 300, "z" * 60, words(900)]
    texts += [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in texts[:20]]
    R.shuffle(texts)
    data = [(i * 2, t) for i, t in enumerate(texts)]
    return data + [data[7], (None, texts[4]), (None, None)]


def check(spark, data):
    df = spark.createDataFrame([(i, t, None, None, 7, "clash") for i, t in data], SCHEMA).repartition(5)
    got = r.repeated_bytes(df).collect()
    assert len(got) == len(data) and {tuple(x) for x in got} == brute(data)


def test_against_brute_force(spark):
    for _ in range(2):
        check(spark, corpus())


def test_many_batches_and_parts(spark, monkeypatch):
    for name, value in (("BATCH_BYTES", 700), ("CHUNK_BYTES", 3000), ("PART_BYTES", 500), ("ROWS", 64)):
        monkeypatch.setattr(r, name, value)
    check(spark, corpus())


def test_hot_anchors_by_narrow_contexts(spark, monkeypatch):
    for name, value in (("HOT", 3), ("CHUNK_BYTES", 3000), ("PART_BYTES", 2000), ("INDEXED", 16)):
        monkeypatch.setattr(r, name, value)
    line = "This line stands at the head of very many of the documents, as notices do."
    data = corpus()
    check(spark, data + [(1000 + i, line + words(20)) for i in range(40)])


def test_unlike_rows_of_one_doc_id(spark):
    p, x, a, b = ("".join(R.choices("abcdefgh ", k=120)) for _ in range(4))
    check(spark, [(1, p + x), (2, a + p), (2, b), (3, b), (3, b + a), (3, a), (2, b)])


def test_any_column_names(spark):
    names = ["doc_id", "text", "a.b", "row", "of", "which", "places", "marks", "__of", "__marks", "`odd`"]
    text = "The same passage of more than fifty bytes stands in both documents."
    quoted = [f"`{n.replace('`', '``')}`" for n in names]
    df = spark.createDataFrame([(1, text, *"cdefghijk"), (2, "x" + text, *"cdefghijk")], ", ".join(f"{q} {'long' if n == 'doc_id' else 'string'}" for n, q in zip(names, quoted)))
    got = r.without_repeats(df)
    assert got.columns == names and {x[1] for x in got.collect()} == {text, "x"} and {tuple(x)[2:] for x in got.collect()} == {tuple("cdefghijk")}
    assert {x.n_removed for x in r.repeated_bytes(df).collect()} == {0, len(text)}


def test_anchors_of_long_texts_in_segments(monkeypatch):
    data = np.frombuffer(words(2000).encode(), np.uint8)
    off = np.array([0, len(data)])
    whole = r.anchors(data, off)
    monkeypatch.setattr(r, "BATCH_BYTES", 1000)
    parts = r.anchors(data, off)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert 0.04 < len(whole[0]) / len(data) < 0.1


def test_texts_and_empty(spark):
    assert r.repeated_bytes(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "ä" * 70 + "one"
    got = r.without_repeats(spark.createDataFrame([(1, long, "x", "s", 9, "m"), (2, "two" + long[1:], "y", "s", 9, "m")], "doc_id long, text string, lang string, source string, n_chars long, other string")).orderBy("doc_id").collect()
    assert [(x.text, x.n_chars, x.lang, x.other) for x in got] == [(long, 73, "x", "m"), ("two", 3, "y", "m")]


def test_the_hash_of_an_anchor_is_that_of_its_context():
    data = np.frombuffer(words(200).encode(), np.uint8)
    off = np.array([0, len(data)])
    at, h = r.anchors(data, off)
    text, bits = r.contexts(data, off, np.zeros(len(at), int), at)
    assert np.array_equal(r._hashes(text, np.full(len(at), r.WIDE, np.uint8), bits)[0], h)


def test_shuffles_end_with_the_staged_table_they_make(spark):
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    docs = spark.createDataFrame([(i, t, None, None, 7, "clash") for i, t in corpus()], SCHEMA)
    first = spark.sparkContext._jsc.sc().newShuffleId()
    marks = r.repeat_marks(docs)
    left = [k for k in range(first + 1, spark.sparkContext._jsc.sc().newShuffleId()) if known.containsShuffle(k)]
    # two sums of sizes, of one row a task: texts, anchors and contexts are gone
    assert len(left) <= 2 and marks.count() > 0
