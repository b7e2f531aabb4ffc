"""Streams with timers: any order and any triggers give what the batch operators give, and state ends."""

import random

import pytest
from pyspark.sql import functions as F

from tonegrid.operators import ordered as O
from tonegrid.operators import recall as R
from tonegrid.streaming.timed import timed_pauses, timed_recall


def replay(spark, folder, parts, build, late):
    """The parts as triggers of their own; returns the rows and the last progress that has state."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = build(stream, late).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][-1]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(build(stream, late).schema).parquet(f"{folder}/out"), held


def dealt(spark, rows, schema, n, seed):
    rng = random.Random(seed)
    shuffled = rng.sample(rows, len(rows))
    parts = [spark.createDataFrame(shuffled[i::n], schema) for i in range(n)]
    return [*parts, spark.createDataFrame([("~end", *rows[0][1:])], schema)]  # its time is far ahead


def with_time(df):
    at = F.when(F.col("stimulus_id") == "~end", F.lit(10_000_000.0)).otherwise(F.col("onset"))
    return df.withColumn("ts", F.timestamp_millis(((at + 86_400) * 1000).cast("long")))  # a stream begins after the epoch, its first watermark


@pytest.mark.parametrize("seed", [1, 2])
def test_pauses_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, t * 1.3, t * 1.3 + rng.choice([0.2, 1.0])) for k in ("a", "b", "c") for t in range(40)]
    schema = "stimulus_id string, onset double, offset double"
    parts = [with_time(p) for p in dealt(spark, rows, schema, 4, seed)]
    got, held = replay(spark, str(tmp_path), parts, lambda s, late: timed_pauses(s, 0.5, late=late, keep_seconds=3600), "1 hour")
    want = O.pauses(spark.createDataFrame(rows, schema), 0.5).select("stimulus_id", "onset", "pause")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    assert held[-1] <= 8  # what is left: the last row, which nothing has passed, and its timer


def test_a_silent_stimulus_is_forgotten(spark, tmp_path):
    schema = "stimulus_id string, onset double, offset double"
    parts = [[("a", 10.0, 11.0)], [("b", 5000.0, 5001.0)], [("b", 9000.0, 9001.0)], [("a", 9500.0, 9501.0), ("a", 9502.0, 9503.0)], [("~end", 0.0, 0.0)]]
    frames = [with_time(spark.createDataFrame(p, schema)) for p in parts]
    got, _ = replay(spark, str(tmp_path), frames, lambda s, late: timed_pauses(s, 0.5, late=late, keep_seconds=600), "1 second")
    assert ("a", 9502.0, 1.0) in [tuple(r) for r in got.collect()] and got.where("stimulus_id = 'a' and onset = 9500").count() == 0


def test_recall_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["apple", "fig", "pear", "um"]), 0.7 * i) for k in ("a", "b") for i in range(30)]
    schema = "stimulus_id string, pos long, word string, onset double"
    pool = spark.createDataFrame([(0, "apple"), (1, "fig"), (2, "Fig")], "pool_index int, item string")
    parts = [with_time(p) for p in dealt(spark, rows, schema, 3, 4)]
    got, _ = replay(spark, str(tmp_path), parts, lambda s, late: timed_recall(s, pool, late=late), "1 hour")
    batch = R.annotate_recall(spark.createDataFrame(rows, schema).withColumn("offset", F.col("onset")), pool, fuzzy=False).select("stimulus_id", "pos", "pool_index", "repetition", "irt")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_late_words_are_dropped(spark, tmp_path):
    schema = "stimulus_id string, onset double, offset double"
    parts = [[("a", 100.0, 101.0)], [("a", 500.0, 501.0)], [("a", 90.0, 91.0), ("a", 495.0, 496.0)], [("~end", 0.0, 0.0)], [("~end", 0.0, 0.0)]]
    frames = [with_time(spark.createDataFrame(p, schema)) for p in parts]
    got, _ = replay(spark, str(tmp_path), frames, lambda s, late: timed_pauses(s, 0.5, late=late), "10 seconds")
    assert sorted(map(tuple, got.collect())) == [("a", 495.0, 394.0), ("a", 500.0, 4.0)]
