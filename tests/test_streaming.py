"""Streams give what the batch operators give."""

import os

from pyspark.sql import functions as F

from tonegrid.operators import ordered as O
from tonegrid.operators import recall as R
from tonegrid.streaming.online_grid import online_context, online_grid, online_pauses, online_recall


def replay(spark, tmp_path, df, build, mode, name):
    df.coalesce(1).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_online_grid_equals_batch(spark, tmp_path):
    rows = [("a", 0.2, 1.0), ("a", 0.4, None), ("a", 1.1, 5.0), ("b", 0.1, 2.0), ("a", 0.3, 3.0)]
    df = spark.createDataFrame(rows, "stimulus_id string, t double, value double").withColumn("ts", F.expr("cast(timestamp_micros(bigint(t * 1000000)) as timestamp_ntz)"))
    got = replay(spark, tmp_path, df, lambda s: online_grid(s, 0.5), "complete", "online_grid_test")
    table = {(r.stimulus_id, r.window_start.timestamp()): (r["mean"], r["max"], r.rate) for r in got.collect()}
    assert table == {("a", 0.0): (2.0, 3.0, 6.0), ("a", 1.0): (5.0, 5.0, 2.0), ("b", 0.0): (2.0, 2.0, 2.0)}
    sliding = replay(spark, tmp_path, df, lambda s: online_context(s, 1.0, 0.5), "complete", "online_context_test")
    assert {(r.stimulus_id, r.context_start.timestamp()): r.context_mean for r in sliding.collect()}["a", 0.5] == 5.0


def test_online_pauses_equal_batch(spark, tmp_path):
    words = spark.createDataFrame([("a", 0.0, 0.5), ("a", 1.0, 1.2), ("a", 1.3, 1.5), ("b", 0.0, 0.1), ("b", 2.0, 2.1)], "stimulus_id string, onset double, offset double")
    got = replay(spark, tmp_path, words, online_pauses, "append", "online_pauses_test")
    want = O.pauses(words).select("stimulus_id", "onset", "pause")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_online_recall_keeps_its_state_between_triggers(spark, tmp_path):
    said = ["apple", "pear", "Apple!", "fig", "fig", "apple"]
    words = spark.createDataFrame([(k, i, w, 0.7 * i, 0.7 * i + 0.4) for k in ("a", "b") for i, w in enumerate(said)], "stimulus_id string, pos long, word string, onset double, offset double")
    pool = spark.createDataFrame([(0, "apple"), (1, "fig"), (2, "FIG")], "pool_index int, item string")
    for part in range(2):
        words.where(f"pos div 3 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        for file in (tmp_path / "in" / f"p{part}").glob("*.parquet"):
            os.utime(file, (1_000_000 + part, 1_000_000 + part))
    stream = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = online_recall(stream, pool).writeStream.outputMode("append").format("memory").queryName("online_recall_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 2
    want = R.annotate_recall(words, pool, fuzzy=False).select("stimulus_id", "pos", "pool_index", "repetition", "irt")
    row = lambda r: (r.stimulus_id, r.pos, r.pool_index, r.repetition, None if r.irt is None else round(r.irt, 3))
    assert sorted(map(row, spark.table("online_recall_test").collect()), key=str) == sorted(map(row, want.collect()), key=str)


def test_late_rows_are_left_out_after_the_watermark(spark, tmp_path):
    """STR5: a row of a closed window is dropped, one that is late but inside the watermark still counts. (The watermark that drops rows is the one of the trigger before.)"""
    triggers = [[("a", 10.0, 1.0)], [("a", 100.0, 1.0)], [("a", 101.0, 1.0)], [("a", 95.0, 5.0), ("a", 11.0, 9.0)], [("a", 300.0, 1.0)]]
    for n, rows in enumerate(triggers):
        df = spark.createDataFrame(rows, "stimulus_id string, t double, value double").withColumn("ts", F.expr("timestamp_micros(bigint(t * 1000000))"))
        df.coalesce(1).write.parquet(str(tmp_path / "late" / f"p{n}"))
        for file in (tmp_path / "late" / f"p{n}").glob("*.parquet"):
            os.utime(file, (1_000_000 + n, 1_000_000 + n))  # read in this order
        schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "late"))
    q = online_grid(stream, 10.0, late="30 seconds").writeStream.outputMode("append").format("memory").queryName("late_test").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {int(r.window_start.timestamp()): (r["max"], r.rate) for r in spark.table("late_test").collect()}
    assert got == {10: (1.0, 0.1), 90: (5.0, 0.1), 100: (1.0, 0.2)}
