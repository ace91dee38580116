import random
import re
from collections import Counter

from stratum.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, None, None, "clash") for i, t in enumerate(texts)], SCHEMA)


RANDOM = random.Random(7)


def prose():
    return "\n".join(" ".join(RANDOM.choice([RANDOM.choice(q.COMMON["en"]), "w" + "".join(RANDOM.choices("aeioustn", k=6))]) for _ in range(15)) + "." for _ in range(12))


def test_base_counts(spark):
    texts = ["", None, "one", "a b c a b c", "x\x0by\x0cz\rw", "é# 日本 |&|\n\n é \n é", "a a a a a", "l\nl \nl\n\t\nl", " ".join(f"w{i % 40}" for i in range(9000)), prose() * 2]
    got = {r.doc_id: r for r in q.apply_rules(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert tuple(r)[1:6] == brute(t), t
        assert r.base_failed == (r[1] < 50 or 100 * r[5] > 50 * r[1])
        assert not (r.base_failed and r.kept)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(q, "HASH", 1 << 60)
    texts = ["a b c a b c d", "z " + " ".join(f"w{i % 40}" for i in range(300)), " ".join(f"v{i}" for i in range(90))]
    for r in q.apply_rules(rows(spark, texts)).collect():
        assert tuple(r)[1:6] == brute(texts[r.doc_id])


def test_verdict_and_plan(spark):
    clean = [prose() for i in range(30)]
    junk = [" ".join(f"{w}{i}$$$" for i, w in enumerate(f"zork blip {k} frob".split() * 30)) for k in range(2)]
    out = q.apply_rules(rows(spark, clean + junk))
    got = [r.kept for r in out.orderBy("doc_id").collect()]
    assert all(got[:30]) and not any(got[30:])
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_empty(spark):
    assert q.apply_rules(rows(spark, [])).collect() == []
