"""Keyed state with timers, and upkeep that survives a restart between batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathom.streaming import jobs
from fathom.streaming.stability import STATE_STORE, sequences, stability

T0 = dt.datetime(2024, 1, 1)
SNAPS = "scope string, ts timestamp, entropy double, topics array<string>"


@pytest.fixture
def store(spark):
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.unset(STATE_STORE[0])


class Restarted:
    """Runs a stream to its end for each batch of rows, each time as a new query over the same checkpoint."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.n = spark, tmp_path, schema, 0

    def __call__(self, make, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        df = make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in")))
        q = df.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return self.spark.read.parquet(str(self.path / "out")).collect()


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_stability_over_restarts(spark, tmp_path, store):
    run = Restarted(spark, tmp_path, SNAPS)
    run(stability, [("a", at(0), 0.9, ["x", "y"]), ("b", at(0), 0.9, ["x"]), ("c", at(0), 0.1, [])])
    run(stability, [("a", at(2), 0.8, ["x", "y"]), ("b", at(2), 0.3, ["x"]), ("c", at(1), 0.9, ["p"])])
    rows = run(stability, [("a", at(8), 0.8, ["x", "z"]), ("a", at(9), 0.2, ["x", "z"]), ("b", at(8), None, None), ("a", at(1), 0.9, ["late"])])
    rows = run(stability, [("d", at(30), 0.1, ["x"]), ("a", at(30 + 7 * 60), 0.1, ["x", "z"])])
    snaps = {(r.scope, r.ts): r for r in rows if r.reason != "entropy"}
    churn = {k: r.churn for k, r in snaps.items()}
    assert churn == {("a", at(0)): None, ("b", at(0)): None, ("c", at(0)): None, ("a", at(2)): 0.0, ("b", at(2)): 0.0, ("c", at(1)): 1.0, ("a", at(8)): pytest.approx(2 / 3), ("a", at(9)): 0.0, ("b", at(8)): 1.0, ("d", at(30)): None, ("a", at(450)): 0.0}
    assert {k for k, r in snaps.items() if r.reason == "churn"} == {("c", at(1)), ("a", at(8))}
    assert snaps["a", at(9)].average == pytest.approx(2 / 9) and not snaps["a", at(9)].stable
    assert snaps["a", at(450)].average == 0.0 and snaps["a", at(450)].stable
    # b's entropy fell after two minutes, a's stayed up for five, over a restart
    held = {(r.scope, r.ts) for r in rows if r.reason == "entropy"}
    assert ("a", at(5)) in held and not any(s == "b" for s, _ in held)


def test_sequences_go_on(spark, tmp_path, store):
    run = Restarted(spark, tmp_path, "session_id string, id long, ts timestamp")
    run(sequences, [("s", 5, at(1)), ("s", 4, at(0)), ("t", 1, at(0))])
    rows = run(sequences, [("s", 3, at(2)), ("s", 2, at(2))])
    assert {(r.session_id, r.id): r.sequence for r in rows} == {("s", 4): 1, ("s", 5): 2, ("s", 2): 3, ("s", 3): 4, ("t", 1): 1}


def test_edges_of_batches_that_waited_over_a_restart(spark, tmp_path):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    make = lambda: jobs.EdgeBuilder(lambda: frame(range(100)), lambda new, every: new.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), str(tmp_path), least=5)
    make()(frame([1, 2]), 0)
    make()(frame([3]), 1)
    make()(frame([4, 5, 6]), 2)
    make()(frame([7]), 3)
    make()(frame([4, 5, 6]), 2)  # a repeated batch
    edges = lambda: sorted(r.a for r in spark.read.parquet(str(tmp_path / "edges")).collect())
    assert edges() == [1, 2, 3, 4, 5, 6]
    make()(frame([8, 9, 10, 11]), 4)
    assert edges() == list(range(1, 12))


def test_reclustering_counts_over_a_restart(spark, tmp_path):
    runs = []
    make = lambda: jobs.Reclusterer(lambda: runs.append(1) or spark.range(1), str(tmp_path), every=10)
    for number, n in enumerate((4, 4, 4, 9, 0, 1)):
        make()(spark.range(n), number)
    assert len(runs) == 2


def test_watched_code_is_replaced(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string, ts timestamp")
    watch = lambda rows, number: jobs.CodeWatcher(str(tmp_path))(frame(rows), number)
    state = lambda: sorted((r.path, r.name, r.code) for r in jobs.CodeWatcher(str(tmp_path)).chunks(spark).collect())
    watch([("a.rs", "fn a() {}", at(0)), ("b.py", "def b():\n    pass\n", at(0))], 0)
    assert state() == [("a.rs", "a", "fn a() {}"), ("b.py", "b", "def b():\n    pass\n")]
    watch([("a.rs", "fn old() {}", at(1)), ("a.rs", "fn c() {}", at(2)), ("b.py", "def b():\n    pass\n", at(2))], 1)
    watch([("a.rs", "fn old() {}", at(1)), ("a.rs", "fn c() {}", at(2)), ("b.py", "def b():\n    pass\n", at(2))], 1)
    assert state() == [("a.rs", "c", "fn c() {}"), ("b.py", "b", "def b():\n    pass\n")]
    watch([("b.py", None, at(3))], 2)
    assert state() == [("a.rs", "c", "fn c() {}")]
