import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from stratum.streaming import stores as s

EVENT = "key string, item string, at timestamp, seq long, op string, body string"
START = dt.datetime(2024, 5, 1)


def run(spark, tmp_path, batches, schema, query, name):
    """Each batch is a file, and each file a micro-batch."""
    s.with_state(spark)
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{k:03d}"))
    files = sorted(folder.glob("b*/part-*"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, f in enumerate(files):
        f.rename(flat / f"{k:03d}.parquet")
        os.utime(flat / f"{k:03d}.parquet", (1_700_000_000 + 10 * k,) * 2)  # files come in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    q = query(stream).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def events(seed, n=90):
    r = random.Random(seed)
    out = [(r.choice("ab"), f"i{r.randrange(5)}", START + dt.timedelta(minutes=r.randrange(300)), k, r.choice(["save", "save", "save", "remove"]), f"body {k}") for k in range(n)]
    out += [out[3], out[3], out[7]] + [("a", None, START, 1, "save", "x"), (None, "i", START, 1, "save", "x"), ("a", "i1", None, 1, "save", "x"), ("a", "i1", START, 1, "other", "x")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("cuts", [1, 5])
def test_a_stream_says_what_the_batch_says(spark, tmp_path, cuts):
    rows = events(cuts)
    size = -(-len(rows) // cuts)
    got = run(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)], EVENT, s.changes, f"store{cuts}")
    assert {tuple(r) for r in s.current(got).collect()} == {tuple(r) for r in s.stored(spark.createDataFrame(rows, EVENT)).collect()}
    last = got.groupBy("key").agg(F.max_by("n_items", "change").alias("n")).collect()
    counts = {r.key: r["count"] for r in s.stored(spark.createDataFrame(rows, EVENT)).groupBy("key").count().collect()}
    assert {r.key: r.n for r in last} == counts


def test_removing_the_latest_gives_way_to_the_next(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("u", "s1", at(1), 1, "save", "a"), ("u", "s2", at(2), 2, "save", "b"), ("u", "s3", at(3), 3, "save", "c"), ("u", "s3", at(4), 4, "remove", None), ("u", "s1", at(0), 0, "save", "old"), ("u", "s3", at(2), 9, "save", "late")]
    got = {r.item: r for r in s.stored(spark.createDataFrame(rows, EVENT)).collect()}
    assert set(got) == {"s1", "s2"} and got["s2"].is_latest and not got["s1"].is_latest
    assert got["s1"].body == "a" and got["s1"].created == at(0) and got["s1"].updated == at(1)


def test_tombstones_go_when_the_watermark_has_passed(spark, tmp_path):
    at = lambda d: START + dt.timedelta(days=d)
    batches = [[("u", "x", at(0), 1, "save", "a"), ("u", "y", at(0), 1, "save", "b")], [("u", "x", at(1), 2, "remove", None)], [("u", "y", at(20), 3, "save", "c")], [("u", "y", at(21), 4, "save", "d")], [("u", "z", at(22), 5, "save", "e")]]
    got = run(spark, tmp_path, batches, EVENT, s.changes, "tombs")
    assert {(r.item, r.body, r.is_latest) for r in s.current(got).collect()} == {("y", "d", False), ("z", "e", True)}


def test_jobs_and_jobs_that_stall(spark, tmp_path):
    schema = "job string, stage string, at timestamp, seq long, status string"
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [
        [("j1", "read", at(0), 1, "running"), ("j2", "read", at(0), 1, "running"), ("j1", "read", at(5), 2, "done")],
        [("j1", "write", at(9), 3, "done"), ("j1", "read", at(1), 0, "failed"), ("j3", "a", at(10), 1, "failed")],
        [("j4", "a", at(600), 1, "running")], [("j4", "a", at(601), 2, "running")],
    ]
    got = run(spark, tmp_path, batches, schema, s.progress_changes, "jobs")
    last = {r.job: r.now for r in got.groupBy("job").agg(F.max_by(F.struct("stages", "done", "failed", "status", "updated"), "change").alias("now")).collect()}
    batch = {r.job: r for r in s.progress(spark.createDataFrame([e for b in batches for e in b], schema)).collect()}
    assert {j: tuple(r)[:3] for j, r in last.items()} == {j: (r.stages, r.done, r.failed) for j, r in batch.items()}
    assert {j: r.status for j, r in last.items()} == {"j1": "done", "j2": "stalled", "j3": "failed", "j4": "running"}
    assert batch["j2"].status == "running" and batch["j1"].updated == at(9)


def test_an_item_is_read_and_written_once_a_batch():
    import pandas as pd

    calls = []

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return self

        def getValueState(self, *_):  # noqa: N802
            return self

        def registerTimer(self, *_):  # noqa: N802
            pass

        def exists(self):
            return False

        def update(self, value):
            pass

        def containsKey(self, key):  # noqa: N802
            calls.append("read")
            return False

        def getValue(self, key):  # noqa: N802
            calls.append("read")

        def updateValue(self, key, value):  # noqa: N802
            calls.append("write")

    store = s._Store()
    store.init(Handle())
    frame = pd.DataFrame({"item": ["a"] * 5, "at": pd.to_datetime(["2024-01-01"] * 5), "seq": range(5), "op": ["save"] * 5, "body": list("vwxyz")})
    told = pd.concat(store.handleInputRows(("k",), iter([frame]), None))
    assert calls == ["read", "write"] and told.body.tolist() == ["z"] and told.n_items.tolist() == [1]


@pytest.mark.parametrize("cuts", [1, 6])
def test_items_as_an_aggregate_say_what_the_batch_says(spark, tmp_path, cuts):
    """Removals that come late cut earlier saves off, a batch that is written twice counts once, and no item goes through Python."""
    rows = events(10 + cuts) + [("c", "x", START + dt.timedelta(minutes=m), k, op, f"c {k}") for k, (m, op) in enumerate([(5, "save"), (9, "save"), (7, "remove"), (1, "save"), (9, "save"), (9, "remove"), (11, "save")])]
    size = -(-len(rows) // cuts)
    (tmp_path / "in").mkdir()
    for k in range(cuts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], EVENT).coalesce(1).write.parquet(str(tmp_path / "cut" / str(k)))
        (file,) = (tmp_path / "cut" / str(k)).glob("part-*")
        file.rename(tmp_path / "in" / f"{k}.parquet")
    changed = str(tmp_path / "changes")

    def put(df, k):
        for _ in range(2):
            df.withColumn("change", F.lit(k).cast("long")).write.mode("append").parquet(changed)

    before = {name: spark.conf.get(name, None) for name in s.STATE}
    s.with_state(spark)
    try:
        stream = s.item_changes(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        assert "Python" not in stream._jdf.queryExecution().logical().toString() and "InPandas" not in stream._jdf.queryExecution().logical().toString()
        query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    batches = spark.read.schema(s.ITEM_CHANGE).parquet(changed)
    assert batches.select("change").distinct().count() >= cuts
    assert {tuple(r) for r in s.items_current(batches).collect()} == {tuple(r) for r in s.stored(spark.createDataFrame(rows, EVENT)).collect()}


def test_the_streamed_store_keeps_its_state_without_python(spark, monkeypatch):
    from stratum.plans import catalog

    monkeypatch.setattr(s, "changes", None)
    rows = [{tuple(r) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} for name in ("store_streamed", "store_current")]
    assert rows[0] == rows[1] and len(rows[0]) > 50
