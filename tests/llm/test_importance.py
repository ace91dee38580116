import hashlib
import math
import random
import re
import zlib

import pytest

from stratum.llm import importance as im

SCHEMA = "doc_id long, text string, key string, id string, score string, `a.b` long"
R = random.Random(31)


def features(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(docs, targets):
    s, t = {}, {}
    for counts, texts in ((s, [d[1] for d in docs]), (t, targets)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] = counts.get(bucket(f), 0) + 1
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (big_s + 10000) / ((s.get(b, 0) + 1) * (big_t + 10000))))
    rows = []
    for i, text in docs:
        n, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    apt = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    most = 25 * len(apt) // 100
    return sorted(((i, n, w, sc, k) for k, (i, _, n, w, sc) in [(next((k + 1 for k, a in enumerate(apt[:most]) if a is r), None), r) for r in rows]), key=repr)


def texts(n):
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "naïve", "日本", "X9", "a'b", "\x1c", "--", "ÀB"]
    out = [" ".join(R.choice(vocabulary) for _ in range(R.choice([0, 1, 2, 19, 20, 21, 80]))) for _ in range(n)]
    return out + [None, "", "...", "same words here " * 9, "same words here " * 9, " ".join(f"w{k}" for k in range(5000))]


def rows(spark, docs):
    return spark.createDataFrame([(i, t, "k", "i", "s", 1) for i, t in docs], SCHEMA)


def target(spark, values):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(values)], "item_id long, text string, key string")


def check(spark, docs, targets):
    got = im.resample(rows(spark, docs), target(spark, targets)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, targets)


def test_against_brute_force(spark):
    docs = [(3 * k, t) for k, t in enumerate(texts(300))]
    check(spark, docs, texts(9) + ["w1 w2 w3 w4"])
    check(spark, docs, [])


def test_repeated_rows_and_no_ids(spark):
    docs = [(k, t) for k, t in enumerate(texts(60))]
    # what rows of one doc_id share in rank has no order of its own: their ranks are compared as a whole
    doubled = docs + [(None, docs[4][1]), docs[7], docs[7]]
    got, want = im.resample(rows(spark, doubled), target(spark, ["w5 w6"])).collect(), brute(doubled, ["w5 w6"])
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, (r[:4] for r in want)))
    assert sorted(r.rank for r in got if r.rank) == sorted(r[4] for r in want if r[4])


def test_no_rows(spark):
    check(spark, [], ["w1 w2"])
    check(spark, [(1, None), (2, "few words only")], ["w1 w2"])


@pytest.mark.parametrize("orders", [1, 3])
def test_orders(spark, orders):
    table = im.positions(spark.createDataFrame([(1, 5, "a b c"), (2, 6, "d")], "key long, id long, text string"), orders).collect()
    want = {(1, *[zlib.crc32(" ".join("abc"[p : p + n]).encode()) % 10000 if p + n <= 3 else None for n in range(1, orders + 1)]) for p in range(3)}
    assert {(r.key, *r[2:]) for r in table if r.key == 1} == want
    assert [r[2:] for r in table if r.key == 2] == [(zlib.crc32(b"d") % 10000, *[None] * (orders - 1))]
