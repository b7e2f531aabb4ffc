"""Medians by radix selection and novelty by bands, against plain computations."""

import random
import statistics
import struct

import numpy as np
import pytest

from tonegrid.kernels import dsp
from tonegrid.operators import novelty, quantile


def test_medians(spark):
    rng = random.Random(1)
    rows = [("odd", float(v)) for v in rng.sample(range(-500, 500), 201)] + [("even", rng.uniform(-1e-3, 1e300)) for _ in range(100)]
    rows += [("ties", 2.0)] * 50 + [("ties", 3.0)] * 50 + [("one", -7.25), ("none", None), ("none", float("nan")), (None, 1.0), (None, 4.0)]
    rows += [("tiny", struct.unpack("<d", struct.pack("<q", k))[0]) for k in range(9)] + [("zero", v) for v in (-0.0, 0.0, -5e-324, float("inf"), float("-inf"))]
    rows += [("mixed", v) for v in (None, 1.0, float("nan"), 2.0, None, 10.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.m for r in quantile.median(df, ["g"], "v", "m").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        x = [v for k, v in rows if k == g and v is not None and v == v]
        want[g] = statistics.median(x) if x else None
    assert got == want and got["ties"] == 2.5 and got["mixed"] == 2.0


def test_one_hot_group_and_two_keys(spark):
    df = spark.range(200_000).selectExpr("'hot' as a", "cast(id % 2 as int) as b", "cast((id * 7919) % 200003 as double) / 3 as v")
    got = {(r.a, r.b): r.median for r in quantile.median(df, ["a", "b"], "v").collect()}
    x = (np.arange(200_000) * 7919) % 200_003 / 3
    assert got == {("hot", k): pytest.approx(float(np.median(x[k::2]))) for k in (0, 1)}
    assert quantile.median(df.where("false"), ["a"], "v").count() == 0


@pytest.mark.parametrize(("n", "step", "half", "rows"), [(90, 2, 4, 16), (41, 3, 2, 8), (5, 2, 3, 8), (1, 2, 2, 8)])
def test_novelty_equals_the_kernel(spark, n, step, half, rows):
    rng = np.random.default_rng(n)
    clips = {k: np.cumsum(rng.standard_normal((n, 5)), axis=0) for k in ("a", "b")}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, m in clips.items() for i, v in enumerate(m)], "stimulus_id string, i int, v array<double>").repartition(3)
    got = {(r.stimulus_id, r.block): r.novelty for r in novelty.novelty(df, "v", ["i"], step, half, width=7, rows=rows).collect()}
    for k, m in clips.items():
        want = dsp.novelty(m, step / 0.2, 0.2, 0.4 * half)["novelty"]
        assert [got[k, b] for b in range(len(want))] == pytest.approx(want.tolist(), abs=1e-9)
    assert len(got) == 2 * len(want)
