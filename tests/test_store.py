"""Commits of several tables: all or nothing, once, and the latest run of a stimulus."""

import pytest
from pyspark.sql import functions as F

from tonegrid.plans.store import TableStore


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "stimulus_id string, v int")


def state(store, kind):
    return sorted((r.stimulus_id, r.v) for r in store.read(kind).collect())


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def test_replacement_and_repeated_runs(spark, store):
    with pytest.raises(ValueError):
        store.read("frames")
    a = store.publish({"frames": rows(spark, ("a", 1), ("b", 2), ("b", 3)), "beats": rows(spark, ("a", 9))}, "one")
    assert a["version"] == 1 and a["runs"][0]["tables"] == {"frames": {"rows": 3}, "beats": {"rows": 1}}
    for _ in range(2):
        store.publish({"frames": rows(spark, ("b", 7), ("c", 8))}, "two", stimuli=rows(spark, ("a", 0)))
    assert state(store, "frames") == [("b", 7), ("c", 8)] and state(store, "beats") == [] and store.manifest()["version"] == 2
    store.publish({"frames": rows(spark, ("a", 5)).withColumn("w", F.lit(1))}, "three")
    assert state(store, "frames") == [("a", 5), ("b", 7), ("c", 8)] and store.kinds() == ["beats", "frames"]


def test_a_failed_run_shows_nothing(spark, store):
    store.publish({"frames": rows(spark, ("a", 1)), "beats": rows(spark, ("a", 1))}, "one")
    bad = rows(spark, ("a", 2)).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.publish({"frames": rows(spark, ("a", 2)), "beats": bad}, "two")
    assert state(store, "frames") == state(store, "beats") == [("a", 1)]
    assert len(store.clean()) == 1 and state(store, "frames") == [("a", 1)]
    store.publish({"frames": rows(spark, ("a", 2)), "beats": rows(spark, ("a", 2))}, "two")
    assert state(store, "beats") == [("a", 2)]


def test_two_writers_at_once(spark, store, monkeypatch):
    """The second writer's number is taken between its look and its commit."""
    store.publish({"frames": rows(spark, ("a", 1))}, "one")
    other, put = TableStore(spark, store.folder), store._put
    done = []

    def late(name, content):
        if not done:
            done.append(other.publish({"frames": rows(spark, ("b", 2))}, "other"))
        return put(name, content)

    monkeypatch.setattr(store, "_put", late)
    store.publish({"frames": rows(spark, ("c", 3))}, "two")
    assert state(store, "frames") == [("a", 1), ("b", 2), ("c", 3)] and [r["seq"] for r in store.manifest()["runs"]] == [1, 2, 3]


def test_compaction(spark, store, monkeypatch):
    for i in range(4):
        store.publish({"frames": rows(spark, ("a", i), (f"s{i}", i))}, f"run {i}")
    before = state(store, "frames")
    began = store._live

    def live(kind, at):  # a run is published while the compaction writes
        TableStore(spark, store.folder).publish({"frames": rows(spark, ("a", 99))}, "meanwhile")
        return began(kind, at)

    monkeypatch.setattr(store, "_live", live)
    now = store.compact()
    monkeypatch.undo()
    assert [r["seq"] for r in now["runs"]] == [4, 5]
    assert state(store, "frames") == sorted([p for p in before if p[0] != "a"] + [("a", 99)])
    store.publish({"frames": rows(spark, ("a", 1))}, "run 2")
    assert state(store, "frames")[0] == ("a", 99) and len(store.clean()) == 4


def test_micro_batches_are_runs(spark, store, tmp_path):
    rows(spark, ("a", 1), ("b", 2)).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema("stimulus_id string, v int").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sink = store.sink(lambda batch: {"frames": batch}, "words")

    def run():
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    rows(spark, ("b", 5)).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    assert state(store, "frames") == [("a", 1), ("b", 5)]
    sink(rows(spark, ("b", 77)), 1)  # a batch that a restart repeats
    assert state(store, "frames") == [("a", 1), ("b", 5)]
