import math

import pytest
from pyspark.sql import functions as F

from tonegrid.operators import grid as G


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(("duration", "hop", "n"), [(3.0, 0.5, 6), (3.0000000001, 0.5, 6), (3.1, 0.5, 7), (0.0, 0.5, 1), (0.1, 0.5, 1)])
def test_window_count(spark, duration, hop, n):
    assert spark.range(1).select(G.window_count(F.lit(duration), hop)).first()[0] == n


def test_bad_hop():
    with pytest.raises(ValueError):
        G.window_count(None, 0)


def test_centres(spark):
    s = G.spine(rows(spark, [("a", 2.0)], "stimulus_id string, duration double"), 0.5)
    assert [r.time for r in s.orderBy("k").collect()] == [0.25, 0.75, 1.25, 1.75]


def test_reductions_skip_missing_and_fold_overhang(spark):
    native = rows(spark, [("a", 0.1, 1.0), ("a", 0.2, float("nan")), ("a", 0.3, 3.0), ("a", 1.2, None), ("a", 9.0, 7.0), ("a", -3.0, 5.0)], "stimulus_id string, t double, v double")
    d = rows(spark, [("a", 2.0), ("b", 1.0)], "stimulus_id string, duration double")
    got = {(r.stimulus_id, r.k): r for r in G.to_grid(native, d, 0.5, ("v",), ("v",), "rate").collect()}
    assert len(got) == 6
    assert got["a", 0].v_mean == 3.0 and got["a", 0].v_max == 5.0 and got["a", 0].rate == 8.0
    assert got["a", 2].v_mean is None and got["a", 2].rate == 2.0
    assert got["a", 3].v_mean == 7.0  # beyond the end: the last window
    assert got["b", 0].v_mean is None and got["b", 0].rate == 0.0


def test_infinite_maximum_is_missing(spark):
    native = rows(spark, [("a", 0.1, math.inf)], "stimulus_id string, t double, v double")
    d = rows(spark, [("a", 0.5)], "stimulus_id string, duration double")
    assert G.to_grid(native, d, 0.5, maxes=("v",)).first().v_max is None


def test_empty_native_table_still_has_a_grid(spark):
    native = rows(spark, [], "stimulus_id string, t double, v double")
    d = rows(spark, [("a", 1.0)], "stimulus_id string, duration double")
    got = G.to_grid(native, d, 0.5, means=("v",), rate="rate").collect()
    assert [(r.v_mean, r.rate) for r in got] == [(None, 0.0)] * 2
