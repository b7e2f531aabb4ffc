"""Landmark scaling against classical scaling of all rows, and its traversal against a plain one."""

import numpy as np
import pytest

from tonegrid.explore import landmarks as L


def frame(spark, x, **extra):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(4), names


def pairwise(y):
    return np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))


def places(df):
    return np.array([r.projection for r in df.orderBy("id").collect()])


def plain_traversal(x, count):
    x, out = sorted(x.tolist()), []
    at = np.array(x)
    near = np.sqrt(((at - at.mean(axis=0)) ** 2).sum(axis=1))
    while len(out) < count:
        i = int(np.argmax(near))  # rows are sorted, the first of equals is the smallest
        if out and near[i] == 0:
            break
        d = np.sqrt(((at - at[i]) ** 2).sum(axis=1))
        near = d if not out else np.minimum(near, d)
        out.append(x[i])
    return np.array(out)


def test_plane_in_many_dimensions_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 6)) + 5
    df, names = frame(spark, x)
    placed, chosen = L.landmark_mds(df, names, 2, landmarks=8)
    assert len(chosen.points) == 8
    assert np.allclose(pairwise(places(placed)), pairwise(x), atol=1e-7)
    assert L.stress(df, names, 2, chosen) < 1e-8


def test_all_rows_as_landmarks_equal_classical_scaling(spark):
    x = np.random.default_rng(5).normal(size=(24, 4))
    df, names = frame(spark, x)
    placed, chosen = L.landmark_mds(df, names, 3, landmarks=24)
    assert len(chosen.points) == 24
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred @ centred.T)
    whole = axes[:, ::-1][:, :3] * np.sqrt(values[::-1][:3])
    assert np.allclose(pairwise(places(placed)), pairwise(whole), atol=1e-7)
    assert 0 < L.stress(df, names, 3, chosen) < 0.5


def test_traversal_with_ties_and_copies(spark):
    x = np.array([[0, 0], [4, 0], [0, 4], [4, 4], [4, 4], [0, 0], [2, 2], [2, 1]], dtype=float)
    df, names = frame(spark, x)
    for count in (1, 3, 5, 8):
        assert np.array_equal(L.farthest_points(L.with_vector(df, names), count).points, plain_traversal(x, count))
    y = np.random.default_rng(2).integers(0, 4, size=(200, 3)).astype(float)
    df, names = frame(spark, y)
    assert np.array_equal(L.farthest_points(L.with_vector(df, names), 12).points, plain_traversal(y, 12))


def test_missing_entries_and_few_distinct_rows(spark):
    x = np.array([[1, 2, np.nan], [1, 2, np.nan], [3, np.nan, np.nan], [1, 2, np.nan]])
    df, names = frame(spark, x)
    placed, chosen = L.landmark_mds(df.withColumn("projection", df["id"]), names, 2, landmarks=9)
    assert placed.columns == ["id", *names, "projection"]
    assert len(chosen.points) == 2  # the third column has no value, the second only one
    y = places(placed)
    assert np.allclose(pairwise(y)[0], [0, 0, 2, 0]) and np.allclose(y[:, 1], 0)


def test_bounds(spark):
    df, names = frame(spark, np.zeros((2, 2)))
    with pytest.raises(ValueError):
        L.landmark_mds(df, names)
    with pytest.raises(ValueError):
        L.farthest_points(L.with_vector(df, names), L.LANDMARKS_MAX + 1)
    with pytest.raises(ValueError):
        L.farthest_points(L.with_vector(df.limit(0), names), 3)
