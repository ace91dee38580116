import random
import re

import numpy as np
import pytest

from stratum.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, id string, root string, `a.b` long"
R = random.Random(23)


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def brute(data):
    """Rows of one doc_id are one document with the links of all its texts."""
    sets = [(i, shingles(t)) for i, t in data if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def words(n):
    return [f"w{R.randrange(5000)}" for _ in range(n)]


def chain(n, length, step):
    """Texts of which each is near the one before it only."""
    text, out = words(length), []
    for k in range(n):
        out.append(" ".join(text))
        text[k * step % length : k * step % length + step] = [f"c{k}x{i}" for i in range(step)]
    return out


def corpus():
    out = chain(30, 120, 2) + chain(20, 40, 1)
    for g in range(14):
        base = words(R.choice([9, 10, 11, 12, 20, 39, 60, 150, 400]))
        for _ in range(R.choice([1, 2, 9, 40])):
            copy = list(base)
            for _ in range(R.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                copy[R.randrange(len(copy))] = f"x{R.randrange(9999)}"
            copy += [f"y{R.randrange(9999)}" for _ in range(R.choice([0, 0, 1, 2]))]
            out.append(" ".join(w.upper() if R.random() < 0.1 else w for w in copy))
    passage = words(60)
    out += [" ".join(words(6) + passage + words(5)) for _ in range(40)]
    out += ["", None, " \n", "one two", "ONE  two", "one two three", "été Été", "\x1cx y", "a b c d e", "A B C D\tE", " ".join(words(9000)), "z " * 5000]
    R.shuffle(out)
    data = [(i * 3 + 1, t) for i, t in enumerate(out)]
    return data + [data[5], (None, out[3]), (None, None)]


def check(spark, data):
    got = nj.ngram_join(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in data], SCHEMA)).collect()
    assert len(got) == len(data)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(data)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_small_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(nj, "GROUP", 3)
    monkeypatch.setattr(nj, "BATCH_BYTES", 2000)
    check(spark, corpus())


def test_one_doc_id_with_unlike_texts(spark):
    near = chain(3, 60, 1)
    check(spark, [(9, near[0]), (4, words(1)[0]), (9, "quite another text of eight words is here"), (2, "quite another text of eight words is here"), (7, near[1]), (5, near[2])])


def test_no_rows(spark):
    check(spark, [])
    check(spark, [(1, None), (2, ""), (None, "a b c")])


@pytest.mark.parametrize("size", [9, 10, 11, 18, 19, 20, 38, 57, 100, 333, 1500])
def test_linked_sets_share_a_key_and_pass_the_bound(size):
    """The most that two linked sets may differ, at any split of it: none is lost."""
    rng = np.random.default_rng(size)
    for other in range(max(1, size * 9 // 10), size + 1):
        both = -(-90 * (size + other) // 190)
        if both > other:
            continue
        for _ in range(20):
            h = rng.integers(0, 1 << 63, size + other - both, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(h[:size]), np.sort(np.concatenate([h[:both], h[size:]]))
            assert nj.linked(a, b) and nj.linked(b, a)
            if size != other or both != size:
                assert set(nj.keys_of(a)) & set(nj.keys_of(b)), (size, other)
            maps = nj.bitmap(a), nj.bitmap(b)
            few = min(map(len, maps))
            assert nj.may_link(size, other, *(nj.folded(m, few) for m in maps))
            less = np.sort(np.concatenate([b[1:], [np.uint64(1)]]))
            assert nj.linked(a, less) == (100 * len(np.intersect1d(a, less)) >= 90 * len(np.union1d(a, less)))


def test_folded_bitmaps():
    own = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 700, dtype=np.uint64))
    wide = nj.bitmap(own)
    assert len(wide) == 32
    bits = np.zeros(512, np.uint8)
    bits[(own & np.uint64(511)).astype(int)] = 1
    assert np.array_equal(nj.folded(wide, 8), np.packbits(bits).view(np.uint64))
