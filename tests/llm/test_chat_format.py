import hashlib
import re

from stratum.llm import chat_format as c
from stratum.llm.queries import CONTROL

SCHEMA = "conv_id long, turn long, role string, text string, piece string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def brute(data):
    by = {}
    for x in sorted(data, key=lambda x: tuple((v is not None, v) for v in x[:4])):
        by.setdefault(x[0], []).append((x[2] or "", x[3] or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {k: "".join(t for r, t in v if r == "assistant") for k, v in by.items()}
    return {k: (len(v), digest("".join(f"{r}\n{t}\n" for r, t in v)), len(loss[k]), digest(loss[k])) for k, v in by.items()}


def test_against_brute_force(spark):
    texts = ["", None, "plain", CONTROL, "<|im_end|", "<\\|x", "<\\\\|y<|", "|im_end|>", "é日本\n<|im_start|>user\n", "x" * 5000, "\\n"]
    roles = ["user", "assistant", None, "sys\ntem", "a<|b\\n"]
    data = [(k % 7, k // 3, roles[k % 5], texts[k % 11], "x") for k in range(160)]
    data += [data[3], (None, 1, "user", "no id", "x"), (9, None, "assistant", "no turn", None), (9, 0, "assistant", "then", None)]
    got = {r[0]: tuple(r)[1:5] for r in c.read_back(c.format_chat(rows(spark, data))).collect()}
    assert got == brute(data)


def test_round_trip_of_the_text_itself(spark):
    data = [(1, 0, "user", CONTROL, ""), (1, 1, "assistant", CONTROL + "<\\|", "")]
    (row,) = c.format_chat(rows(spark, data)).collect()
    assert c.parse(row.formatted) == [("user", CONTROL), ("assistant", CONTROL + "<\\|")]
    assert row.formatted.count(c.START) == 2 and row.formatted.count(c.END) == 2
    assert [c.unescape(row.formatted[a:b]) for a, b in zip(row.loss_starts, row.loss_ends)] == [CONTROL + "<\\|"]
    assert len(re.findall(r"<\|", row.formatted)) == 4


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(c, "PIECE_BYTES", 2000)
    data = [(k // 90, k, "assistant", f"turn {k} " * 9, "") for k in range(200)]
    columns = list(zip(*data))
    table = pa.table({"conv_id": pa.array(columns[0]), "turn": pa.array(columns[1]), "role": pa.array(columns[2]), "text": pa.array(columns[3])})
    pieces = list(c._formatted(iter(table.to_batches(max_chunksize=17))))
    assert sum(len(b) for b in pieces) > 3
    got = [r for b in c._read_back(iter(pieces)) for r in b.to_pylist()]
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == brute(data)


def test_empty(spark):
    assert c.read_back(c.format_chat(rows(spark, []))).collect() == []
