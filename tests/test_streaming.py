from pyspark.sql import functions as F

from stratum.streaming import events


def test_stream_windows_equal_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", k, float(h + m)) for h in range(3) for m in (1, 20, 59) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    query = events.windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("stream_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM stream_windows").collect())) == sorted(map(tuple, events.windows(df).collect()))


def test_stream_sessions_equal_the_batch(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"topic{c}x{t} one two three" if t % 4 == 0 else "ok") for c in range(5) for t in range(c + 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.filter("turn < 3").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.filter("turn >= 3").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    last = {}

    def keep(batch, _):
        last.update({r.conv_id: tuple(r) for r in batch.collect()})

    for part in ("a", "b"):  # the second run goes on from the first one's state
        source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in") + ("/a" if part == "a" else "/*"))
        query = events.session_contexts(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"state{part}")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert last == {r.conv_id: tuple(r) for r in events.session_contexts(df).collect()}


def test_sessions_read_whole_texts(spark):
    url = "https://a.example/" + "x" * 300
    texts = [f"{url} says one two", "w" * 90 + " " + "v" * 120 + " third fourth", "\u3000one\x1ftwo\xa0three four", "one two three ", "", None]
    rows = [(c, t, "user", x if t == 0 else "no topic here") for c, x in enumerate(texts) for t in range(2)] + [(9, t, "user", f"t{t} b c d") for t in range(30)]
    got = {r.conv_id: (r.turns, r.topic) for r in events.session_contexts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    split = {c: (2, x.split()[0] if x and len(x.split()) > 3 else None) for c, x in enumerate(texts)}
    assert got == split | {9: (20, "t29")}
