import math
import random

import numpy as np
import pytest

from stratum.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, d string, `a.b` long"
R = random.Random(41)


def brute(data):
    rows = {}
    for i, v, label in data:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [max(-hn.MOST, min(hn.MOST, math.floor(256 * float(np.float32(x))))) for x in v])
        rows[i] = min(rows.get(i, own), own)
    rows = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in rows.items()}
    out = []
    for a, (own, q) in rows.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in rows.items() if i != a}
        for p in sorted((i for i in score if rows[i][0] == own), key=lambda i: (-score[i], i))[:5]:
            met = [i for i in score if rows[i][0] != own and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(sorted(met, key=lambda i: (-score[i], i))[:5])]
    return sorted(out)


def vectors(n, dims, labels=10):
    centers = [[R.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = R.randrange(labels) if R.random() < 0.7 else 0
        out.append((i, [c + R.gauss(0, 0.7) for c in centers[R.randrange(labels) if R.random() < 0.5 else label]], label))
    return out


def check(spark, data):
    got = hn.hard_negatives(spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in data], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(data)
    return got


def test_against_brute_force(spark):
    data = vectors(900, 8)
    data += [(1000 + 100 * k, list(data[5][1]), data[5][2]) for k in range(3)] + [(2000 + k, list(data[9][1]), k % 3) for k in range(30)]
    data += [(None, data[0][1], 1), (5000, None, 1), (5100, [None] * 8, 1), (5200, [float("nan")] * 8, 1), (5300, [float("inf")] * 8, 1), (5400, data[3][1], None)]
    data += [(5500, [], 2), (5600, [0.5, 1.0], 3), (5601, [0.0] * 8, 3), data[100], (100, [0.25] * 8, 9)]
    assert check(spark, data)


@pytest.mark.parametrize("anchors, rows, pivots", [(2, 16, 3), (1000, 7, 40)])
def test_small_tiles(spark, monkeypatch, anchors, rows, pivots):
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "ROWS", rows)
    monkeypatch.setattr(hn.pivot_table, "__defaults__", (hn.ANCHOR_EVERY, pivots))
    check(spark, vectors(420, 6, 4))


def test_large_components_and_one_label(spark):
    check(spark, [(i, [R.choice([1e30, -1e30, 3e5, 1e-3]), R.gauss(0, 1)], i % 2) for i in range(230)])
    assert check(spark, [(7 * i + 1, [1.0, float(i)], 3) for i in range(40)]) == []


def test_few_and_none(spark):
    assert check(spark, []) == []
    assert check(spark, [(100, [1.0], 1)]) == []
    check(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [-1.0], 2)])


def test_brackets_hold_scores():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-300, 300, (400, 12)), rng.integers(-3, 3, (50, 12))]).astype(float)
    most = float((x * x).sum(1).max())
    points = hn.fit_pivots(x[:100], most, 9)
    d = hn._distances(x, np.sqrt(most - (x * x).sum(1)), points)
    for q in x[::40]:
        dq = hn._distances(q[None], np.zeros(1), points)[0]
        tile = hn._Tile.__new__(hn._Tile)
        tile.to_rows, tile.to_anchors, tile.most, tile.squares = d.T, dq[None], most, np.array([(q * q).sum()])
        low, high = tile.brackets(0)
        assert ((low <= x @ q) & (x @ q <= high)).all()
        assert (high - low).min() < 2 * most  # brackets say something


def test_pivots_rule_out_other_clusters():
    """Vectors in tight clusters: few rows are checked exactly. (Where all directions are alike, brackets rule out next to nothing.)"""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    centers = rng.normal(0, 200, (12, 24))
    x = np.floor(centers[rng.integers(0, 12, 3000)] + rng.normal(0, 12, (3000, 24))).astype(np.int32)
    most = float((x.astype(float) ** 2).sum(1).max())
    points = hn.fit_pivots(x[:600].astype(float), most, 16)
    batch = pa.record_batch([pa.array(np.arange(3000)), pa.array(np.zeros(3000, np.int64)), pa.array(list(x), pa.list_(pa.int32()))], names=["id", "label", "v"])
    table = pa.Table.from_batches(list(hn._pivoted(24, most, points, 100)([batch])))
    anchors = table.filter(pa.array([i % 100 == 0 for i in range(3000)]))
    found = hn._positives(24, most, 5)(anchors, table).to_pylist()
    share = sum(r["checked"] for r in found) / len(found) / 3000
    assert len(found) == 150 and share < 0.3
    exact = x.astype(int) @ x.astype(int).T
    for r in found:
        order = sorted((i for i in range(3000) if i != r["anchor_id"]), key=lambda i: (-exact[r["anchor_id"], i], i))[:5]
        assert r["positive_id"] in order and r["positive_score"] == exact[r["anchor_id"], r["positive_id"]]
