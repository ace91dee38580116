import random
import re

import numpy as np

from stratum.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, lang string, source string, digest long"
R = random.Random(11)


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(data):
    sets = [(i, shingles(t)) for i, t in data if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def words(n):
    return [f"w{R.randrange(5000)}" for _ in range(n)]


def corpus():
    out = []
    for g in range(12):
        base = words(R.randint(6, 150))
        for _ in range(R.choice([1, 2, 9, 40])):
            copy = list(base)
            for _ in range(R.choice([0, 0, 1, 2, 3, 5])):
                copy[R.randrange(len(copy))] = f"x{R.randrange(9999)}"
            out.append(" ".join(w.upper() if R.random() < 0.1 else w for w in copy))
    passage = words(40)
    out += [" ".join(words(30) + passage + words(20)) for _ in range(30)]
    out += ["", None, " \n", "one two", "ONE  two", "one two three", "été Été", "\x1cx y", "a b c d e", "A B C D\tE", " ".join(words(9000))]
    R.shuffle(out)
    data = [(i * 3 + 1, t) for i, t in enumerate(out)]
    return data + [data[5], (None, out[3]), (None, None)]


def check(spark, data):
    got = nd.near_duplicates(spark.createDataFrame([(i, t, None, "s", 1) for i, t in data], SCHEMA)).collect()
    assert len(got) == len(data)
    assert {tuple(r) for r in got if r.doc_id is not None} == brute(data)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    monkeypatch.setattr(nd, "GROUP", 3)
    check(spark, corpus())


def test_sketches_estimate_similarity():
    for share in (0.95, 0.85, 0.75, 0.3):
        n, estimates = 400, []
        for k in range(30):
            rng = np.random.default_rng(k)
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            more = round(n * (1 - share) / 2 / share)
            sets = [np.concatenate([both, rng.integers(0, 1 << 63, more, dtype=np.uint64)]) for _ in range(2)]
            a, b = nd.odd_sketches(np.stack([nd.samples(s) for s in sets])).view(np.uint64)
            estimates.append(nd.estimate(int(nd._differing(a, b[None])[0])))
        assert abs(np.mean(estimates) - share) < (0.03 if share > 0.5 else 0.1)
        assert share < 0.75 or min(estimates) > nd.estimate(nd.MOST_BITS)


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nd.without_near_duplicates(spark.createDataFrame([(1, "a", None, None, None)] * 2, SCHEMA)).count() == 2


def test_recall_near_the_threshold():
    """Of 1,500 pairs at a similarity of 0.75 to 0.77, those that share a band and pass the sketch bound."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(1500):
        both = int(rng.integers(90, 600))
        other = int(both / rng.uniform(0.75, 0.77)) - both
        h = rng.integers(0, 1 << 63, both + other, dtype=np.uint64)
        cut = int(rng.integers(0, other + 1))
        low = np.stack([nd.samples(np.concatenate([h[:both], h[both : both + cut]])), nd.samples(np.concatenate([h[:both], h[both + cut :]]))])
        keys, sketches = nd.bands(low), nd.odd_sketches(low).view(np.uint64)
        found += bool((keys[0] == keys[1]).any()) and int(nd._differing(sketches[0], sketches[1:])[0]) <= nd.MOST_BITS
    assert found >= 1499
