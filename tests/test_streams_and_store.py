"""Streams that end by themselves, and the memory store."""

import datetime as dt

from pyspark.sql import functions as F

from fathom.sources.tables import MemoryStore, chunks_jsonl, read
from fathom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def drained(spark, df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(15)
    q.stop()
    return spark.table(name)


def test_windows(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 10, 70)]
    out = drained(spark, jobs.windowed_counts(stream_of(spark, tmp_path, rows, "ts timestamp, event_type string, value double")), tmp_path, "complete").collect()
    assert sorted(r.n for r in out) == [1, 2]


def test_sessions(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=m), 1) for m in (0, 10, 100)]
    out = drained(spark, jobs.sessions(stream_of(spark, tmp_path, rows, "ts timestamp, user_id long")), tmp_path, "complete").collect()
    assert sorted(r.n for r in out) == [1, 2]


def test_changed_files(spark, tmp_path):
    rows = [("p", "x", T0), ("p", "x", T0), ("p", "y", T0)]
    out = drained(spark, jobs.changed_files(stream_of(spark, tmp_path, rows, "path string, text string, ts timestamp")), tmp_path)
    assert out.count() == 2


def test_churn_state(spark, tmp_path):
    rows = [("s", T0, ["a", "b", "c"]), ("s", T0 + dt.timedelta(hours=1), ["b", "c", "d"])]
    out = drained(spark, jobs.churn(stream_of(spark, tmp_path, rows, "scope string, ts timestamp, topics array<string>")), tmp_path).collect()
    assert [r.churn for r in out] == [0.5]


def test_upsert_is_repeatable(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [(1, "a")], "id long, text string")
    jobs.upsert(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("id", "text").collect() == [(1, "a")]


def test_memory_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a", 0.5, T0), (1, "b", 0.6, T0 + dt.timedelta(days=1)), (2, "c", 0.5, T0)], "id long, content string, importance double, created_at timestamp")
    store.store(rows)
    assert {(r.id, r.content) for r in store.memories().collect()} == {(1, "b"), (2, "c")}
    store.forget(rows.where(F.col("id") == 2).select("id"), "2024-01-03 00:00:00", "test")
    assert [r.id for r in store.memories().collect()] == [1]
    assert store.trail(target=1).count() == 2
    assert store.trail(start="2024-01-02 00:00:00").count() == 1


def test_chunks_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "x", "chunk_idx": 0}\nnot json\n')
    assert [r.text for r in chunks_jsonl(spark, str(tmp_path / "c.jsonl")).collect()] == ["x"]
    spark.range(2).write.orc(str(tmp_path / "o"))
    assert read(spark, str(tmp_path / "o"), "orc").count() == 2
