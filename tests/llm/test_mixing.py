import re

from stratum.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], SCHEMA)


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_budgets_are_met_exactly(spark):
    data = [(k, "w " * (k % 13), f"s{min(k % 9, 4)}" if k % 17 else None) for k in range(400)] + [(1000, "long " * 900, "s1"), (1001, None, "s2"), (1002, "a b", "tiny"), (1003, "", "none")]
    got = mixing.mix(rows(spark, data)).collect()
    source = {i: s for i, _, s in data}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(data) and {r.doc_id: r.size for r in got} == {i: len((t or "").split()) for i, t, _ in data}
    want = expected_targets(sizes)
    assert all(abs(want[s] - target[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    assert all(taken[s] == int(target[s] + 1e-9) for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(rows(spark, data)).collect()))


def test_repeated_rows_and_empty(spark):
    assert mixing.mix(rows(spark, [])).collect() == []
    got = mixing.mix(rows(spark, [(1, "a b c", "x")] * 4 + [(2, "d e f g", "y")])).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 3)] * 4 + [(2, 4)]


def test_documents_of_the_mix(spark):
    data = [(k, f"t{k}  w\n" * (k % 13), f"s{k % 4}") for k in range(200)]
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(rows(spark, data)).collect()}
    mixed, text = {}, {i: t for i, t, _ in data}
    for r in mixing.mixed_documents(rows(spark, data)).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(re.findall(r"\S+", r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert all(mixed.get(i, 0) == t for i, (_, t) in taken.items())
