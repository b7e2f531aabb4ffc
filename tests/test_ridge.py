"""Blocked moments, penalties and out-of-fold predictions against NumPy on the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import embeddings as E


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 21))
    y = x @ rng.standard_normal(21) + 0.3 * rng.standard_normal(300) + 2
    fold = np.arange(300) % 4
    rows = [(int(f), v.tolist(), float(t)) for f, v, t in zip(fold, x, y, strict=True)]
    df = spark.createDataFrame([*rows, (0, None, 1.0), (0, [0.0] * 21, None), (None, [0.0] * 21, 1.0), (1, [None] + [0.0] * 20, 1.0)], "fold int, v array<double>, y double")
    return x, y, fold, df.repartition(7)


def solve(x, y, alpha):
    mx, my = x.mean(axis=0), y.mean()
    c = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return c, my - mx @ c


@pytest.mark.parametrize("tile", [4, 16, 64])
def test_moments(data, tile):
    x, y, fold, df = data
    cells = {(r.fold, r.i, r.j): r.value for r in E.ridge_moments(df, "v", "y", "fold", tile).collect()}
    for f in range(4):
        v = np.column_stack([x, y, np.ones(300)])[fold == f]
        m = v.T @ v
        assert all(cells.pop((f, i, j)) == pytest.approx(m[i, j], abs=1e-9) for i in range(23) for j in range(i, 23))
    assert not cells


def test_path_choice_and_predictions(data):
    x, y, fold, df = data
    alphas = [0.01, 1.0, 100.0]
    fit = E.Ridge(E.gram_tiles(df, "v", "y", "fold", 8))
    want = {}
    for a in alphas:
        for f in range(4):
            c, b = solve(x[fold != f], y[fold != f], a)
            want[a, f] = ((y[fold == f] - x[fold == f] @ c - b) ** 2).sum()
    assert {(a, f): e for a, f, n, e in fit.path(alphas)} == {k: pytest.approx(v) for k, v in want.items()}
    best = min(alphas, key=lambda a: sum(want[a, f] for f in range(4)))
    assert fit.choose(alphas) == best
    guessed = E.out_of_fold(df.where("v is not null and y is not null and fold is not null and v[0] is not null"), "v", "fold", fit, best)
    assert guessed.agg(F.sum((F.col("y") - F.col("guess")) ** 2)).first()[0] == pytest.approx(sum(want[best, f] for f in range(4)))


def test_what_is_shuffled_does_not_grow_with_rows(spark):
    rows = spark.range(20_000).select(F.lit(0).alias("fold"), F.array(*[F.rand(i) for i in range(6)]).alias("v"), F.rand(9).alias("y")).repartition(3)
    plan = E.gram_tiles(rows, "v", "y", "fold")
    partial = plan.count()
    assert partial == 1
    found = E.ridge_fit(rows.withColumn("song", F.col("v")[0]), "v", "y", [1.0], "song")
    assert found["n"] == 20_000 and len(found["coef"]) == 6


def test_vectors_of_several_lengths_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0], 1.0), (0, [1.0, 2.0], 1.0)], "fold int, v array<double>, y double").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        E.gram_tiles(df, "v", "y", "fold").collect()
