import random

import pytest

from stratum.llm import hamming as h

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ids string"
R = random.Random(4)


def vectors():
    centers = [[R.choice([-1.0, 1.0]) for _ in range(h.BITS)] for _ in range(5)]
    data = []
    for i in range(700):
        v = list(R.choice(centers))
        for _ in range(R.choice([0, 1, 3, 9])):
            v[R.randrange(h.BITS)] *= -1
        data.append((i, v, 1, "c", None))
    data += [(i, list(centers[0]), 1, None, None) for i in range(1000, 1100)]
    data += [(2000 + 100 * i, [R.gauss(0, 1) for _ in range(h.BITS)], 1, None, None) for i in range(4)]
    return data + [data[0], data[100], (3000, None, 1, None, None), (3100, [1.0], 1, None, None), (None, list(centers[0]), 1, None, None), (3200, [None] * h.BITS, 1, None, None)]


def brute(data, k):
    codes = {(i, sum((1 << b) * (x is not None and x > 0) for b, x in enumerate(v))) for i, v, *_ in data if i is not None and v is not None and len(v) == h.BITS}
    out = set()
    for q, c in codes:
        if q % 100 == 0:
            near = sorted(((c ^ d).bit_count(), i) for i, d in codes)[:k]
            out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("k", [1, 10, 150])
def test_against_brute_force(spark, k):
    data = vectors()
    got = h.every_hundredth(spark.createDataFrame(data, SCHEMA), k).collect()
    assert {tuple(r) for r in got} == brute(data, k) and len(got) == len(brute(data, k))


def test_segments_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(h, "TOGETHER", 0)
    monkeypatch.setattr(h, "PROBE_ROWS", 8)
    data = vectors()
    assert {tuple(r) for r in h.every_hundredth(spark.createDataFrame(data, SCHEMA), 7).collect()} == brute(data, 7)


def test_distances_that_steps_cover():
    for segments in (2, 3, 5):
        bounds, radii, covered = h._bounds(segments), [-1] * segments, []
        for group, radius, near in h._steps([(a // 4, b // 4) for a, b in bounds]):
            for s, *_ in group:
                assert radii[s] == radius - 1
                radii[s] = radius
            covered.append(near)
            # the nearest code that no probe meets differs in one bit more than each segment was probed to
            assert near == h.BITS or near == sum(r + 1 for r in radii) - 1
        assert covered == sorted(covered) and covered[-1] == h.BITS


def test_few_and_empty(spark):
    few = [(100 * i, [float(i)] * h.BITS, 1, None, None) for i in range(3)]
    assert {tuple(r) for r in h.every_hundredth(spark.createDataFrame(few, SCHEMA)).collect()} == brute(few, 10)
    assert h.every_hundredth(spark.createDataFrame([], SCHEMA)).collect() == []
