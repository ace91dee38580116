from stratum.sources import sinks

TURN = "session_id string, turn int, query string, answer string, kind string, warnings array<string>, citations array<string>, at string"


def turns():
    out = [("s1", k, f"q{k}", f"a{k}", "answer", [], ["c"], f"2024-01-0{k + 1}") for k in range(4)]
    return out + [("s2", 0, "open", "", "no_answer", None, None, "2024-02-01"), ("s2", 1, "bare", "x", "answer", ["thin"], [], "2024-02-02"), ("s2", 2, "fine", "x", "answer", ["thin"], ["c"], "2024-02-03"), (None, 0, "lost", "", "no_answer", None, None, "x"), ("s3", None, "lost", "", "no_answer", None, None, "x")]


def test_batches_replace_themselves(spark, tmp_path):
    df, path = spark.createDataFrame(turns(), TURN), str(tmp_path / "log")
    for _ in range(2):
        sinks.log_turns(df.filter("session_id = 's1'"), path, 0)
        sinks.log_turns(df.filter("session_id = 's2'"), path, 1)
    rows = spark.read.json(path)
    assert rows.count() == 7 and rows.select("audit_envelope.record_id").distinct().count() == 7
    second = rows.filter("session_id = 's1' AND turn = 1").first()
    assert second.audit_envelope.parent_turn_id == "s1:0" and second.audit_envelope.turn_id == "s1:1" and second.record_kind == "chat_turn_audit"
    assert rows.filter("turn = 0").first().audit_envelope.parent_turn_id == ""


def test_open_questions(spark, tmp_path):
    sinks.log_unanswered(spark.createDataFrame(turns(), TURN), str(tmp_path / "open"), 3)
    assert {(r.query, r.batch) for r in spark.read.json(str(tmp_path / "open")).collect()} == {("open", 3), ("bare", 3)}


def test_snapshots_of_sessions(spark, tmp_path):
    path = str(tmp_path / "sessions")
    df = spark.createDataFrame(turns(), TURN)
    sinks.snapshot_sessions(df, path, 2)
    more = spark.createDataFrame([*[t for t in turns() if t[0] == "s1"], ("s1", 4, "q4", "a4", "answer", [], [], "2024-03-01")], TURN)
    sinks.snapshot_sessions(more, path, 2)
    got = {r.session_id: r for r in spark.read.parquet(path).collect()}
    assert set(got) == {"s1", "s2"} and got["s1"].n_turns == 5 and [h.turn for h in got["s1"].history] == [3, 4] and got["s1"].updated_at == "2024-03-01"
    assert [h.query for h in got["s2"].history] == ["bare", "fine"]
