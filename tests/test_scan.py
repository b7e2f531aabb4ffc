"""Two-level scans against plain windows, on one hot stimulus and on many."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonegrid.operators import ordered as O
from tonegrid.operators import recall as R
from tonegrid.operators import scan as S

SCHEMA = "stimulus_id string, i int, t double, offset double, word string, v double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = [("hot", i, i * 0.37, i * 0.37 + rng.choice([0.1, 0.4]), rng.choice("aab"), rng.choice([None, 1.0, 2.5])) for i in range(3000)]
    out += [(f"s{k}", i, i * 5.0, i * 5.0 + 1, "x", None if k == 2 else float(i)) for k in range(5) for i in range(rng.choice([1, 2, 40]))]
    out += [(None, i, i * 100.0, i * 100.0 + 1, None, 1.0) for i in range(4)]
    return spark.createDataFrame(out, SCHEMA).repartition(5).cache()


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("width", [0.2, 7.0, 1e9])
def test_scan_equals_windows(rows, width):
    w = Window.partitionBy("stimulus_id").orderBy("t")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("a", F.lag("v").over(w)).withColumn("b", F.sum(F.coalesce("v", F.lit(0))).over(up)).withColumn("c", F.last("v", ignorenulls=True).over(before))
    got = S.scan(rows, "stimulus_id", ["t"], width, a=S.Lag("v"), b=S.Running("v"), c=S.LastBefore("v"))
    names = ("stimulus_id", "i", "a", F.round("b", 6).alias("b"), "c")
    assert as_set(got, *names) == as_set(want, *names)
    assert as_set(S.numbered(rows, "stimulus_id", ["t"], width), "stimulus_id", "i", "_n") == as_set(rows, "stimulus_id", "i", F.col("i").alias("_n"))


@pytest.mark.parametrize(("half", "block"), [(1, 3), (3, 64), (50, 10)])
def test_frames_equal_windows(rows, half, block):
    w = Window.partitionBy("stimulus_id").orderBy("t").rowsBetween(-half, half)
    names = ("stimulus_id", "i", F.round("rolling", 6).alias("r"))
    got = O.rolling_mean(rows, "v", "t", half, width=11.0, block=block)
    assert got.columns == [*rows.columns, "rolling"]
    assert as_set(got, *names) == as_set(rows.withColumn("rolling", F.avg("v").over(w)), *names)


@pytest.mark.parametrize("size", [1, 2, 5, 8])
def test_uniform_filter_equals_padding(rows, size):
    filled = rows.withColumn("x", F.coalesce("v", F.lit(-1.0)))
    got = {(r.stimulus_id, r.i): r.smoothed for r in O.uniform_filter(filled, "x", "t", size, width=3.0, block=16).collect()}
    series = {}
    for r in filled.orderBy("t").collect():
        series.setdefault(r.stimulus_id, []).append(r.x)
    for k, x in series.items():
        for i in range(len(x)):
            at = [min(max(j, 0), len(x) - 1) for j in range(i - size // 2, i - size // 2 + size)]
            assert got[k, i] == pytest.approx(sum(x[j] for j in at) / size)


def test_runs_and_gaps_cross_buckets(spark):
    rows = spark.createDataFrame([("a", i, float(i), i + 0.5, "x" if 100 <= i < 900 else str(i), 0.0) for i in range(1000)], SCHEMA)
    assert O.longest_run(rows, "word", ["t"], width=7.0).collect()[0].max_run == 800
    words = rows.select("stimulus_id", F.col("t").alias("onset"), "offset")
    assert O.pauses(words, 0.5, width=3.0).count() == 999 and O.pauses(words, 0.51, width=3.0).count() == 0


def test_no_window_over_a_whole_stimulus_of_rows(rows):
    """Rows meet by (key, bucket); by key alone only the table of buckets is sorted."""
    plan = O.pauses(rows.withColumnRenamed("t", "onset"), 0.1, ["onset"], width=10.0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    alone = [line for line in windows if "_bucket" not in line.split("],")[1]]
    assert windows and len(alone) == 1
    below = plan.split(alone[0])[1].splitlines()[1:4]
    assert any("Aggregate" in line for line in below)


def test_recall_over_buckets(spark):
    rng = random.Random(2)
    said = [("hot", i, rng.choice(["apple", "banana", "chair", "um"]), i * 1.5, i * 1.5 + 1) for i in range(500)]
    words = spark.createDataFrame(said, "stimulus_id string, pos int, word string, onset double, offset double")
    pool = spark.createDataFrame([("apple", 0), ("banana", 1), ("chair", 2)], "item string, pool_index int")
    got = {r.pos: (r.repetition, r.irt, r.intrusion) for r in R.annotate_recall(words, pool, fuzzy=False, width=9.0).collect()}
    seen, last = set(), None
    for _, pos, word, onset, _ in said:
        if word == "um":
            assert got[pos] == (False, None, True)
            continue
        assert got[pos] == (word in seen, None if last is None else round(onset - last, 3), False)
        seen.add(word)
        last = onset
