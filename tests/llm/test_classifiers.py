import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import quality_classifier as qc
from stratum.llm import toxicity as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
R = random.Random(5)


def brute_segments(scores):
    """Divide and conquer by definition: the best segment (shortest of the first), then what lies left and right."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (a, b, total)
    if best is None:
        return []
    a, b, _ = best
    return brute_segments(scores[:a]) + [best] + [(x + b + 1, y + b + 1, s) for x, y, s in brute_segments(scores[b + 1 :])]


def test_segments_against_brute_force():
    for _ in range(300):
        scores = [round(R.uniform(0.5, 3), 3) if R.random() < 0.3 else -0.7 for _ in range(R.randint(0, 30))]
        got = tx.segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.7)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_of_falling_sums_take_linear_time():
    def seconds(n):
        hits = [(3 * i, 1.0) for i in range(n)]
        began = time.process_time()
        assert len(tx.segments(hits, 0.7)) == n
        return time.process_time() - began

    assert seconds(200_000) < 5


def test_windows_of_lines(monkeypatch):
    texts = ["a b\nc\nd e f\n\nLine again\nLine again", "", "x\n\n", None, "one line only", "\n" * 9]
    data, off = qc.buffers(pa.array(texts))
    whole, size, counts = qc.line_features(data, off)
    lines = qc.Lines(data, off)
    field = qc.Field(whole.mean(0), whole.std(0) + 1e-6)
    field.w = np.random.default_rng(2).normal(size=len(field.w))
    y = np.array([1, 0, 1, 0, 1, 0])
    expected = field.gradients(lines, y)
    model = qc.Model(field)
    features = model.features(pa.array(texts))
    monkeypatch.setattr(qc, "WINDOW", 2)
    assert np.allclose(np.concatenate([lines.features(a, b) for a, b in lines.windows()]), whole)
    assert np.allclose(field.gradients(lines, y), expected) and np.allclose(model.features(pa.array(texts)), features)


def test_a_text_of_line_ends_fits_in_memory():
    field = qc.Field(np.zeros(45), np.ones(45))
    field.w = np.zeros(len(qc.line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0][0]) + 1)
    field.mean, field.scale = np.zeros(len(field.w) - 1), np.ones(len(field.w) - 1)
    tracemalloc.start()
    assert qc.Model(field).features(pa.array(["\n" * 300_000])).shape == (1, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_any_column_names(spark):
    names = ["doc_id", "text", "a.b", "row", "score", "__text", "__score", "y", "half"]
    schema = ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names)
    docs, labels = corpus(spark)
    rows = spark.createDataFrame([(r.doc_id, r.text, *"cdefghi") for r in docs.select("doc_id", "text").collect()], schema)
    kept = tx.without_toxic(rows, labels)
    assert kept.columns == names and {tuple(r)[2:] for r in kept.collect()} == {tuple("cdefghi")}
    assert qc.classify(rows, labels).count() == rows.count()


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 3, 6, 1])
    field = qc.Field(np.zeros(2), np.ones(2))
    field.w, field.t = rng.normal(size=3), rng.normal(size=(2, 2))
    z = np.column_stack([rng.normal(size=(counts.sum(), 2)), np.ones(counts.sum())])
    p, moved = field.marginals(z, counts)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in counts:
        total, ones = 0.0, np.zeros(n)
        local = np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            e = np.exp(sum(s * (z[at + k] @ field.w) for k, s in enumerate(states)) + sum(field.t[a, b] for a, b in zip(states, states[1:])))
            total += e
            ones += e * np.array(states)
            for a, b in zip(states, states[1:]):
                local[a, b] += e
        want += list(ones / total)
        pairs += local / total
        at += n
    assert np.allclose(p, want) and np.allclose(moved, pairs)


def test_lines_and_features():
    texts = ["a b\nc", "", "x\n\n", None, "one line only"]
    data, off = qc.buffers(pa.array(texts))
    starts, ends, counts = qc.lines_of(data, off)
    lines = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert counts.tolist() == [len((t or "").split("\n")) for t in texts]
    assert lines == [x for t in texts for x in (t or "").split("\n")]
    whole, _, _ = qc.line_features(data, off)
    alone = [qc.line_features(*qc.buffers(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(whole, np.concatenate(alone))


def corpus(spark):
    words = ["".join(R.choices("aeiourstn", k=R.randint(2, 7))) for _ in range(300)]
    data, labels = [], []
    for i in range(400):
        text = [R.choice(words) for _ in range(R.randint(20, 90))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        for _ in range(4 if toxic else 0):
            text[R.randrange(len(text))] = R.choice(["vilex", "vilest", "grubby"])
        if junk:
            text = [w.upper() + "!!" for w in text]
        data.append((i, "\n".join(" ".join(text[k : k + 12]) for k in range(0, len(text), 12)), "en", None, 1, "clash"))
        labels.append((i, int(not junk), int(toxic)))
    data += [(1000, None, None, None, None, None), (1001, "", "", "", 0, ""), data[3], (1002, "vilex grubby " * 3000, "en", "s", 1, "")]
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("model, label", [(tx, "toxic"), (qc, "quality")])
def test_held_out_accuracy(spark, model, label):
    docs, labels = corpus(spark)
    got = model.classify(docs, labels).toPandas()
    assert len(got) == 404 and got.score.between(0, 1).all() and got.dtypes.predicted == "int32"
    joined = got.drop_duplicates("doc_id").merge(labels.toPandas().dropna(), on="doc_id")
    held = joined[joined.held_out]
    assert len(held) > 30 and (held.predicted == held[label]).mean() > 0.93
    repeated = got[got.doc_id == 3].score
    assert len(repeated) == 2 and repeated.nunique() == 1
    if model is tx:
        assert got[got.doc_id == 1002].predicted.item() == 1 and got[got.doc_id == 1000].predicted.item() == 0
    again = model.classify(docs, labels).toPandas()
    assert again.sort_values(["doc_id", "score"]).score.round(9).tolist() == got.sort_values(["doc_id", "score"]).score.round(9).tolist()


@pytest.mark.parametrize("model", [tx, qc])
def test_no_labels_and_no_documents(spark, model):
    docs, labels = corpus(spark)
    assert model.classify(docs.limit(5), labels.limit(0)).count() == 5
    assert model.classify(docs.limit(0), labels).count() == 0


def test_beginnings_of_words_are_in_the_lexicon(spark):
    """Forms that no labelled text has are told by their beginning."""
    calm = [f"quiet words {R.randrange(90)} about nothing" for _ in range(300)]
    rude = [f"some words {R.randrange(90)} and a {R.choice(['blorgan', 'blorgish', 'blorgle'])} here" for _ in range(60)]
    rows = [(k, t, None, None, None, None) for k, t in enumerate(calm + rude)] + [(9000, "you blorgidiot there", None, None, None, None), (9001, "you there", None, None, None, None)]
    labels = spark.createDataFrame([(k, None, int(k >= 300)) for k in range(360)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    model = tx.fit(docs, labels)
    assert {"blor*", "blorg*"} <= set(model.lexicon) and all(len(w) in (5, 6, 7, 8) for w in model.lexicon if w.endswith("*"))
    score = {r.doc_id: r.score for r in tx.classify(docs, labels).collect()}
    assert score[9000] > score[9001]


def test_words_with_marks_are_cut_alike(spark):
    text = "हिन्दी cafe\u0301 x_y Été 12"
    words = spark.createDataFrame([(text,)], "t string").selectExpr(f"regexp_extract_all(lower(t), r'{tx.PATTERN}', 0) AS w").first().w
    assert list(words) == tx.WORDS.findall(text.lower()) == ["हिन्दी", "cafe\u0301", "x", "y", "été", "12"]


def test_a_doc_id_that_stands_often_is_one_of_the_sample(spark):
    from stratum.llm import labelled

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r)[:2] for r in labelled.sample(docs, labels, "toxic", 1000, 999, 10).collect()} == {("text 0", 1), (None, 1)}
