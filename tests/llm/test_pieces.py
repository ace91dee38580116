import hashlib
import itertools
import os
import random
import time

import numpy as np
import pytest

from stratum.llm import pieces as s

pytestmark = pytest.mark.skipif(not os.path.exists(s.MODEL), reason="no vocabulary file here")
SCHEMA = "doc_id long, text string, ids string, nbest string"
R = random.Random(2)


def all_segmentations(vocab, part):
    if not part:
        return [(0.0, ())]
    out = []
    for k in range(1, min(len(part), vocab.longest) + 1):
        head = part[:k]
        if head in vocab.ids:
            p = vocab.ids[head]
            out += [(x + vocab.score[p], (p,) + rest) for x, rest in all_segmentations(vocab, part[k:])]
        elif k == 1:
            raw = head.encode()
            out += [(x + vocab.of_byte * len(raw), tuple(vocab.byte[b] for b in raw) + rest) for x, rest in all_segmentations(vocab, part[1:])]
    return out


PARTS = [" the", "tion", " thereof", "é", " ñandú", "\n", "   x", " ▁a", "日本語", " 12.5", "zzz", " \U0001f600k", "\t", " "]


def test_parts_against_enumeration():
    vocab = s.vocabulary(s.MODEL)
    words = PARTS + ["".join(R.choices("abcdeiouthrn ", k=R.randint(1, 8))).replace("  ", "a") for _ in range(60)]
    words = list(dict.fromkeys(w for w in words if w))
    parts = s.Parts(vocab)
    parts._add(words)
    for k, w in enumerate(words):
        every = sorted(all_segmentations(vocab, w), key=lambda x: -x[0])
        ids = tuple(parts.ids[parts.starts[k] : parts.starts[k + 1]])
        assert np.isclose(parts.score[k], every[0][0]) and any(ids == p and np.isclose(x, every[0][0]) for x, p in every), w
        assert np.isclose(parts.loss[k], every[0][0] - every[1][0]) if len(every) > 1 else np.isinf(parts.loss[k])
        got = s.nbest_part(vocab, w, 5)
        assert np.allclose([x for x, _ in got], [x for x, _ in every[:5]])
        assert len(set(p for _, p in got)) == len(got) and all(any(p == q for _, q in every) for _, p in got)
        assert got[0][1] == ids


def test_long_parts_as_short_ones(monkeypatch):
    vocab = s.vocabulary(s.MODEL)
    words = list(dict.fromkeys(w for w in PARTS + ["".join(R.choices("abcdeiouthrné日", k=R.randint(1, 60))) for _ in range(80)] if w))
    short, long = s.Parts(vocab), s.Parts(vocab)
    short._add(words)
    monkeypatch.setattr(s, "LONG", 0)
    long._add(words)
    assert np.array_equal(short.ids, long.ids) and np.allclose(short.score, long.score) and np.allclose(short.loss, long.loss)


def test_a_text_without_spaces_takes_linear_time():
    vocab = s.vocabulary(s.MODEL)

    def seconds(text, n=4):
        began = time.process_time()
        parts = s.Parts(vocab)
        (codes,) = parts.codes([text])
        ids, begin = parts.pieces(codes)
        assert vocab.decode(ids).decode() == text and len(s.nbest(parts, codes, begin, 4)) == n
        return time.process_time() - began

    base = "".join(R.choices("ABCDEFGHabcdefgh0123456789+/", k=100_000))
    assert seconds(base) < 10 and seconds("日本語の文章" * 10_000, 1) < 10 and seconds("a" * 50_000) < 10


def test_any_column_names(spark):
    names = ["doc_id", "text", "a.b", "row", "ids", "nbest", "decoded", "__ids"]
    df = spark.createDataFrame([(1, "some text", *"cdefgh")], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    (r,) = s.encode(df, *names, back=True).collect()
    assert tuple(r.row) == (1, "some text", *"cdefgh") and r.decoded == "some text"
    assert s.encoded_documents(df).count() == 1
    assert s.decode(s.encode(df, *names), "ids", "row").first().decoded == "some text"


def test_texts_against_enumeration():
    vocab = s.vocabulary(s.MODEL)
    for _ in range(25):
        text = " ".join("".join(R.choices("aetionsé", k=R.randint(1, 4))) for _ in range(R.randint(1, 4)))
        parts = s.Parts(vocab)
        (codes,) = parts.codes([text])
        ids, begin = parts.pieces(codes)
        got = s.nbest(parts, codes, begin, 4)
        lists = [all_segmentations(vocab, p) for p in s.PARTS.findall(" " + text)]
        want = sorted((sum(x for x, _ in c) for c in itertools.product(*lists)), reverse=True)[:4]
        assert np.allclose([g["score"] for g in got], want)
        for g in got:
            own = list(ids)
            for c in reversed(g["changes"]):
                own[c["start"] : c["end"]] = c["ids"]
            assert np.isclose(sum(vocab.score[i] if np.isfinite(vocab.score[i]) else vocab.of_byte for i in own), g["score"])
            assert vocab.decode(np.array(own)).decode() == text


def test_forgotten_parts_leave_no_alternatives(monkeypatch):
    monkeypatch.setattr(s, "CACHE", 5)
    parts = s.Parts(s.vocabulary(s.MODEL))
    for text in ("tea no at", "is it on in", "nation sets", "tea no at", "een aan"):
        (codes,) = parts.codes([text])
        ids, begin = parts.pieces(codes)
        lists = [all_segmentations(parts.vocab, p) for p in s.PARTS.findall(" " + text)]
        want = sorted((sum(x for x, _ in c) for c in itertools.product(*lists)), reverse=True)[:4]
        assert np.allclose([g["score"] for g in s.nbest(parts, codes, begin, 4)], want)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(s, "BATCH_BYTES", 3000)
    texts = ["", None, " ", "a", " lead", "trail  ", "x\n\ny\n", "▁ lit▁eral", "<0x0A> <s>", "日本\U0001f600\x00\t", "w" * 3000] + [" ".join("".join(R.choices("abcdefghié", k=R.randint(1, 9))) for _ in range(R.randint(1, 400))) for _ in range(40)]
    data = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, "a", None, None), (None, "no id", None, None)]
    got = s.encoded_documents(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    text = {d[0]: d[1] or "" for d in data}
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and 1 <= len(r.nbest_scores) <= 4
        assert (r.n_pieces == 0) == (text[r.doc_id] == "")


def test_empty(spark):
    assert s.encoded_documents(spark.createDataFrame([], SCHEMA)).collect() == []
