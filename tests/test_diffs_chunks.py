import difflib
import os
import random
import time

import pytest

from stratum.operators import diffs as d
from stratum.operators import model_chunks as mc

R = random.Random(12)


def texts():
    out = [(None, None), ("", "a"), ("a\n", ""), ("a", "a\n"), ("a\nb\nc", "a\nb\nc"), ("x\n" * 40, "x\n" * 37 + "y\n"), ("a\n\n\nb\n", "\n\na\nb"), ("\\ No newline at end of file\n", "-x\n+y\n@@ -1 +1 @@\n")]
    for n in (3, 8, 30, 120):
        for alphabet in ("ab", "abcdefghij", None):
            line = lambda: (R.choice(alphabet) if alphabet else str(R.random())) + "\n"  # noqa: B023, E731
            old = [line() for _ in range(n)]
            new = [x for x in old if R.random() > 0.2]
            for _ in range(n // 4):
                new.insert(R.randrange(len(new) + 1), line())
            out.append(("".join(old), "".join(new)[: -1 if n == 8 else None]))
    return out


TEXTS = texts()


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_patches_give_the_new_text_and_are_shortest(context):
    for old, new in TEXTS:
        patch, hunks, removed, added = d.unified(old, new, context)
        assert d.patched(old, patch) == (new or "")
        a, b = d.lines_of(old), d.lines_of(new)
        assert removed == len(a) - longest(a, b) and added == len(b) - longest(a, b)
        assert hunks == patch.count("\n@@ -") - sum(x.count("@@ -") for x in (old or "", new or "")) or "@@" in (old or "") + (new or "")


def test_the_form_is_that_of_other_tools():
    old, new = "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\n", "a\nB\nc\nd\ne\nf\ng\nh\ni\nk\nj\n"
    want = "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "before", "after"))
    assert d.unified(old, new)[0] == want and d.unified(old, new)[1] == 2
    assert d.unified(old, new, 1)[0] == "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "before", "after", n=1))


def test_a_patch_for_another_text_is_an_error():
    with pytest.raises(ValueError):
        d.patched("other\n", d.unified("a\n", "b\n")[0])


def test_many_lines_take_little_time():
    old = "".join(f"{k % 977}\n" for k in range(20000))
    new = old.replace("\n500\n", "\n501\n").replace("\n13\n", "\n13\nnew\n")
    patch, hunks, removed, added = d.unified(old, new)
    assert d.patched(old, patch) == new and hunks > 30 and removed < added
    assert d.patched("x\n" * 3000 + "y\n", d.unified("x\n" * 3000 + "y\n", "z\n" * 4000)[0]) == "z\n" * 4000


def test_rows(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(TEXTS)], "n long, old string, new string")
    patches = d.diffs(rows, "n")
    done = d.patches_applied(rows.join(patches, "n"), "n")
    assert {r.n: r.text for r in done.collect()} == {k: b or "" for k, (_, b) in enumerate(TEXTS)}


needs_file = pytest.mark.skipif(not os.path.exists(mc.VOCABULARY), reason="no vocabulary here")


def documents():
    words = ["alpha", "Étude", "日本語", "naïve", "x" * 900, "🙂", "1234567890", "a", "(b)", "\t"]
    out = ["", " \n ", "one", "[CODE]\n\nls -l\n\n[/CODE]", "p1\n\np2\n \np3", "🙂" * 400, "字" * 3000, "a" * 20000, "w " * 9000]
    for n in (5, 60, 900):
        out.append("".join(R.choice(words) + R.choice([" ", " ", " ", "\n", "\n\n", "\n\n[TABLE]\na | b\n\nc | d\n[/TABLE]\n"]) for _ in range(n)))
    return out


DOCUMENTS = documents()


@needs_file
@pytest.mark.parametrize("size, overlap", [(160, 32), (12, 5), (1, 0), (0, 9)])
def test_no_chunk_is_above_its_budget(size, overlap):
    tokens = mc.Tokens(mc.VOCABULARY)
    for text in DOCUMENTS:
        found = mc.packed(text, tokens, size, overlap)
        assert bool(found) == bool(text.strip())
        for a, b, n in found:
            assert n == tokens.count(text[a:b]) and (n <= max(1, size) or b - a == 1)
        # all that isn't white space is in some chunk, and chunks go forward
        inside = set().union(*[range(a, b) for a, b, _ in found]) if found else set()
        assert all(k in inside for k, c in enumerate(text) if not c.isspace())
        assert all(p[0] < q[0] and p[1] <= q[1] for p, q in zip(found, found[1:]))


@needs_file
def test_blocks_stay_whole_and_overlap():
    tokens = mc.Tokens(mc.VOCABULARY)
    text = "\n\n".join(f"paragraph number {k} has some words" for k in range(40)) + "\n\n[CODE]\nx\n\ny\n[/CODE]"
    found = mc.packed(text, tokens, 40, 10)
    edges = {a for a, _ in mc.blocks(text)}, {b for _, b in mc.blocks(text)}
    assert all(a in edges[0] and b in edges[1] for a, b, _ in found) and any(q[0] < p[1] for p, q in zip(found, found[1:]))
    assert text[slice(*mc.blocks(text)[-1])] == "[CODE]\nx\n\ny\n[/CODE]"
    whole = tokens.offsets(text)
    assert len(whole) == len(tokens.vocabulary.encode(text, add_special_tokens=False).ids)


@needs_file
def test_chunk_rows(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(DOCUMENTS)] + [(99, None), (None, "no id here")], "doc_id long, text string")
    got = mc.model_chunks(rows, 20, 4).collect()
    texts = dict(enumerate(DOCUMENTS)) | {None: "no id here"}
    assert all(texts[r.doc_id][r.start : r.end] == r.text for r in got) and {r.doc_id for r in got} == {k for k, t in texts.items() if t.strip()}


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_texts_of_many_edits_are_read_from_bit_rows(monkeypatch):
    rng = random.Random(5)
    for most in (d.ROWS_BYTES, 40):
        monkeypatch.setattr(d, "ROWS_BYTES", most)
        for n, kinds in ((0, 1), (1, 1), (9, 2), (64, 3), (150, 20), (200, 300)):
            a = [rng.randrange(kinds) for _ in range(n)]
            b = [rng.randrange(kinds) if rng.random() < 0.4 else x for x in a if rng.random() < 0.8]
            for found in (d._by_rows(a, b), d.matches(a, b)):
                assert len(found) == _longest(a, b) and all(a[i] == b[j] for i, j in found)
                assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(sorted(found), sorted(found)[1:]))


def test_long_texts_of_many_edits():
    rng = random.Random(6)
    a = [rng.randrange(300) for _ in range(12_000)]
    began = time.process_time()
    pairs = d.matches(a, [rng.randrange(300) if k % 9 == 0 else x for k, x in enumerate(a) if k % 7])
    assert time.process_time() - began < 4 and len(pairs) > 8_000


def test_a_task_takes_one_core(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    mc._vocabulary.cache_clear()
    if os.path.exists(mc.VOCABULARY):
        mc.Tokens(mc.VOCABULARY)
        assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
