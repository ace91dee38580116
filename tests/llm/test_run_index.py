import random

import numpy as np

from stratum.llm.run_index import NONE, RunIndex


def matrix(strings, width):
    out = np.zeros((len(strings), width), np.uint8)
    for row, s in zip(out, strings):
        row[: len(s)] = np.frombuffer(s, np.uint8) + 1
    return out, np.array([len(s) for s in strings])


def brute(strings, documents, pattern, k, span):
    length = next((n for n in range(len(pattern) - k, 0, -1) if any(pattern[k : k + n] in s for s in strings)), 0)
    least = min((d for s, d in zip(strings, documents) if pattern[k : k + span] in s), default=NONE) if length >= span else NONE
    return length, least


def test_matching_statistics_against_brute_force():
    r = random.Random(5)
    for span in (8, 9, 13, 16, 20):
        for letters in (b"ab", b"abcd", b"\x00a"):
            base = bytes(r.choices(letters, k=60))
            strings = []
            for _ in range(40):
                a = r.randrange(40)
                s = bytearray(base[a : a + r.randint(0, 30)] or b"")
                if s and r.random() < 0.5:
                    s[r.randrange(len(s))] = r.choice(letters)
                strings.append(bytes(s))
            strings += strings[:5]
            documents = np.sort(np.array([r.randrange(20) for _ in strings]))
            index = RunIndex(*matrix(strings, 31), documents, span)
            assert len(index.starts) <= index.sizes.sum()
            patterns = strings + [bytes(r.choices(letters + b"z", k=r.randint(0, 31))) for _ in range(30)] + [base[:31], base[10:41]]
            found, least = index.matches(*matrix(patterns, 31))
            for i, p in enumerate(patterns):
                for k in range(len(p)):
                    assert (found[i, k], least[i, k]) == brute(strings, documents, p, k, span)


def test_nothing_to_index_or_to_match():
    none = np.zeros((0, 31), np.uint8), np.zeros(0, np.int64)
    assert RunIndex(*none, np.zeros(0, np.int64), 8).matches(*matrix([b"abc"], 31))[0].sum() == 0
    assert RunIndex(*matrix([b"abc"], 31), np.array([1]), 8).matches(*none)[0].shape == (0, 31)
    found, _ = RunIndex(*matrix([b"", b"a"], 31), np.array([1, 2]), 8).matches(*matrix([b"", b"aa"], 31))
    assert found[1, :2].tolist() == [1, 1]


def test_repetitive_strings_take_few_runs():
    r = random.Random(7)
    base = bytes(r.choices(b"abcdefgh", k=81))
    strings = [base[:-3] + bytes(r.choices(b"abcdefgh", k=3)) for _ in range(300)]
    index = RunIndex(*matrix(strings, 81), np.arange(300), 50)
    assert len(index.starts) < index.sizes.sum() / 8
