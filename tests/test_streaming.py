"""The stream leaves what the batch leaves; a restart changes nothing."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from paperlantern.operators.changes import debounce_stream, last_change
from paperlantern.plans import index as index_plan
from paperlantern.plans.index import merge_tail, open_index, segments, write_index
from paperlantern.plans.maintain import apply_changes
from paperlantern.sources.changelog import read_change_log
from paperlantern.streaming.progress import ProgressLog, ingest_progress
from paperlantern.streaming.stream import stream_index
from test_properties import documents

SCHEMA = "index_id string, path string, op string, ts timestamp, event_id int"


@pytest.fixture()
def feed(spark, tmp_path):
    """Three files of events over six documents, and the documents after them."""
    rows = [("i", f"i/d/{n % 6}.txt", ["update", "delete", "create"][n % 3 if n < 20 else (n // 2) % 3], n * 3, n) for n in range(30)]
    df = spark.createDataFrame(rows, "index_id string, path string, op string, s int, event_id int")
    df = df.select("index_id", "path", "op", F.timestamp_seconds("s").alias("ts"), "event_id")
    for part in range(3):
        df.where(F.floor(F.col("event_id") / 10) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return df, str(tmp_path / "feed")


def state(spark, root):
    index = open_index(spark, root)
    return (
        sorted(tuple(r) for r in index.documents.select("path", "size").collect()),
        sorted(tuple(r) for r in index.postings.select("path", "term", "tf").collect()),
        sorted(tuple(r) for r in index.stats.collect()),
    )


def test_stream_equals_batch_and_restarts(spark, feed, tmp_path):
    df, path = feed
    old = documents(spark, [f"old {n}" for n in range(6)])
    new = documents(spark, [f"new text number {n}" for n in range(6)])
    batch_root, stream_root, checkpoint = (str(tmp_path / n) for n in ("batch", "stream", "checkpoint"))
    for root in (batch_root, stream_root):
        write_index(old, root, buckets=2)
    apply_changes(spark, batch_root, df, new)

    for _ in range(2):  # the second run finds nothing new
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        query = stream_index(events, stream_root, lambda batch: new, checkpoint, gap=None, trigger={"availableNow": True})
        query.awaitTermination()
    assert state(spark, stream_root) == state(spark, batch_root)
    assert len(segments(spark, stream_root)) == 4


def test_large_batches_are_written_in_parts(spark, tmp_path, monkeypatch):
    """Ten times the documents: the same peak, one commit, the rows of an uncut write."""
    written, write = [], index_plan._write_bucketed

    def seen(df, path, mode="overwrite"):
        if "/rows/" in path:
            written.append(df.where("bucket < 0 AND NOT deleted").agg(F.sum("size")).first()[0] or 0)
        write(df, path, mode)

    monkeypatch.setattr(index_plan, "_write_bucketed", seen)
    for n, cut in ((8, False), (80, True)):
        old, new = (documents(spark, [f"{word} text number {i:05d} " + "filler " * 20 for i in range(n)]) for word in ("old", "new"))
        changes = new.select("index_id", "path", F.when(F.col("path").endswith("5.txt"), "delete").otherwise("update").alias("op"), F.col("mod_time").alias("ts"), F.lit(1).alias("event_id"))
        states = []
        for limit in (2_000, None):
            root = str(tmp_path / f"{n}-{limit}")
            write_index(old, root, buckets=2)
            written.clear()
            apply_changes(spark, root, changes, new, batch_bytes=limit)
            assert (len(written) > 1) == (cut and limit is not None)
            assert limit is None or max(written) <= limit + 200
            assert [s.seq for s in segments(spark, root)] == [0, 1]
            states.append(state(spark, root))
        assert states[0] == states[1]
    assert not list((tmp_path / "..").glob("shared*/parts-*"))


def test_late_batches_find_as_few_segments_as_early_ones(spark, tmp_path, monkeypatch):
    root, other = str(tmp_path / "merged"), str(tmp_path / "plain")
    docs = documents(spark, [f"text {n}" for n in range(6)])
    for r in (root, other):
        write_index(docs, r, buckets=2)
    most = []
    for n in range(10):
        change = spark.createDataFrame([("i", f"i/d/{n % 6}.txt", ["update", "delete"][n % 4 == 3], n, n)], "index_id string, path string, op string, s int, event_id int")
        change = change.select("index_id", "path", "op", F.timestamp_seconds("s").alias("ts"), "event_id")
        new = documents(spark, [f"new {n}" for _ in range(6)])
        for r in (root, other):
            apply_changes(spark, r, change, new, seq=n + 1)
        merge_tail(spark, root, fan=3)
        most.append(len(segments(spark, root)))
    assert max(most) <= 6 and len(segments(spark, other)) == 11
    assert state(spark, root) == state(spark, other)
    # a replayed batch that was merged already changes nothing
    apply_changes(spark, root, change.withColumn("path", F.lit("i/d/0.txt")), new, seq=2)
    assert state(spark, root) == state(spark, other)


def test_debounced_stream_keeps_the_last_change_per_session(spark, tmp_path):
    rows = [("i", "a", "create", 0, 1), ("i", "a", "update", 5, 2), ("i", "a", "delete", 15, 3), ("i", "a", "update", 60, 4), ("i", "z", "update", 500, 5)]
    df = spark.createDataFrame(rows, "index_id string, path string, op string, s int, event_id int")
    df.select("index_id", "path", "op", F.timestamp_seconds("s").alias("ts"), "event_id").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = debounce_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e")), "10 seconds")
    query = stream.writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    # events exactly one gap apart share a session; the newest one stays open
    got = sorted((r.path, r.op, r.event_id, r.n_changes) for r in spark.table("quiet").collect())
    assert got == [("a", "delete", 3, 3), ("a", "update", 4, 1)]


def test_change_log_stream_and_progress(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.txt").write_text("create:i/x:1.md\nupdate:i/y.md\nbad line\n")
    progress = ProgressLog()
    spark.streams.addListener(progress)
    try:
        query = read_change_log(spark, str(log), streaming=True).writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.path for r in spark.table("log").collect()) == ["i/x:1.md", "i/y.md"]
    finally:
        spark.streams.removeListener(progress)


def test_observed_write(spark, tmp_path):
    seen = Observation("ingest")
    ingest_progress(documents(spark, ["a", "bcd"]), seen).write.parquet(str(tmp_path / "o"))
    assert seen.get == {"documents": 2, "bytes": 4, "failed": 0}


def test_last_change_of_a_hot_path(spark):
    df = spark.range(10_000).select(
        F.lit("i").alias("index_id"), F.lit("p").alias("path"), F.when(F.col("id") == 9_999, "delete").otherwise("update").alias("op"),
        F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"),
    )
    assert [(r.op, r.event_id) for r in last_change(df).collect()] == [("delete", 9_999)]
