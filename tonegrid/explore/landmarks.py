"""Multidimensional scaling of any number of rows by landmarks (VIZ3).

Landmarks are chosen by farthest-point traversal: the first is the row farthest
from the mean, each further one the row whose nearest landmark is farthest (ties:
the smallest vector, so the choice depends on no order of rows and on no key).
Every choice is one max-min aggregate: a task gives its best row, and the best of
these is one row. The distances between the landmarks are scaled classically, and
every row is placed by its distances to the landmarks in a narrow pass. Only
landmarks, at most ``LANDMARKS_MAX`` of them, and one mean a column reach the
driver; a traversal scans the rows once a landmark.

The placement is exact, up to turns and mirrors, where the rows span no more than
``k`` dimensions and the landmarks span them too; otherwise it is the least-squares
placement by distances to landmarks, and ``stress`` says how far it is off.

Cases: missing entries (null or NaN) count as the mean of their column, a column
without any value as 0; repeated rows get the same place; with fewer distinct
rows than landmarks asked for, all distinct rows are landmarks; fewer than three
rows or two columns are an error, as for the other projections; a column of the
input that is called like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .projection import validate

#: Landmarks that a traversal takes; their distances are a dense matrix on the driver.
LANDMARKS_MAX = 500
LANDMARKS = 32
_X = "_landmark_x"


@dataclass(frozen=True)
class Landmarks:
    """Points of the traversal in order, and how far each was from the nearest before it (the first: from the mean)."""

    points: np.ndarray
    reach: np.ndarray


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows by landmarks; differences first, so that near points lose no digits."""
    out = np.empty((len(x), len(points)))
    for j, p in enumerate(points):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def with_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with its ``columns`` as one array of doubles, missing entries filled by the column's mean."""
    numbers = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
    means = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(numbers)]).first()
    return df.withColumn(_X, F.array(*[F.coalesce(x, F.lit(means[i]), F.lit(0.0)) for i, x in enumerate(numbers)]))


def _farthest(points: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            near = _distances(x, points).min(axis=1)
            top = near.max()
            if best is None or top >= best[0]:
                row = min(x[near == top].tolist())
                best = (top, row) if best is None or top > best[0] else (top, min(row, best[1]))
        if best:
            # the greatest negated vector is the smallest vector
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([[-v for v in best[1]]], pa.list_(pa.float64()))], names=["d", "x"])

    return run


def farthest_points(vectors: DataFrame, count: int = LANDMARKS, column: str = _X) -> Landmarks:
    """Farthest-point traversal over an array column of doubles without missing entries."""
    if not 1 <= count <= LANDMARKS_MAX:
        raise ValueError(f"between 1 and {LANDMARKS_MAX} landmarks")
    rows = vectors.select(F.col(column).alias("x")).persist()
    try:
        size = rows.agg(F.max(F.size("x"))).first()[0]
        if size is None:
            raise ValueError("landmarks need at least one row")
        mean = rows.agg(*[F.avg(F.col("x")[i]) for i in range(size)]).first()
        points, reach = [], []
        while len(points) < count:
            best = rows.mapInArrow(_farthest(np.array(points or [list(mean)])), "d double, x array<double>").agg(F.max(F.struct("d", "x")).alias("b")).first().b
            if points and best.d == 0:
                break
            points.append([-v for v in best.x])
            reach.append(best.d)
    finally:
        rows.unpersist()
    return Landmarks(np.array(points), np.array(reach))


def classical_scaling(distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of the landmarks, the (k, landmarks) map that places rows, and the mean squared distances it subtracts.

    Axes follow falling eigenvalues; the entry of an axis that is largest in size is positive. An axis without extent is 0.
    """
    squared = distances**2
    n = len(squared)
    centre = np.eye(n) - 1 / n
    values, axes = np.linalg.eigh(-0.5 * centre @ squared @ centre)
    order = np.argsort(values)[::-1][:k]
    values, axes = values[order], axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    real = values > 1e-9 * max(float(values.max(initial=0)), 1e-300)
    root = np.sqrt(np.where(real, values, 1))
    place, places = np.zeros((k, n)), np.zeros((n, k))
    place[: len(order)] = np.where(real[:, None], axes.T / root[:, None], 0)
    places[:, : len(order)] = np.where(real, axes * root, 0)
    return places, place, squared.mean(axis=0)


def _placed(x: np.ndarray, points: np.ndarray, place: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(x, points)
    return -0.5 * (d**2 - mean) @ place.T, d


def landmark_mds(df: DataFrame, columns: list[str], k: int = 2, landmarks: int = LANDMARKS, name: str = "projection") -> tuple[DataFrame, Landmarks]:
    """``df`` with an array column of ``k`` coordinates, and the landmarks that placed its rows."""
    validate(df.limit(3).count(), len(columns))
    shaped = with_vector(df.drop(name) if name not in columns else df, columns)
    chosen = farthest_points(shaped, landmarks)
    points = chosen.points
    _, place, mean = classical_scaling(_distances(points, points), k)
    fields = [f for f in shaped.schema.fields if f.name not in (_X, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, _ = _placed(_matrix(batch.column(len(fields))), points, place, mean)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(y.tolist(), pa.list_(pa.float64()))], names=[*(f.name for f in fields), name])

    narrow = shaped.select(*[f"`{f.name}`" for f in fields], _X)
    return narrow.mapInArrow(run, StructType([*fields, StructField(name, ArrayType(DoubleType()))])), chosen


def stress(df: DataFrame, columns: list[str], k: int = 2, chosen: Landmarks | None = None) -> float:
    """Root of the squared errors of all distances between rows and landmarks, over the squared distances; 0 is exact.

    All rows count; a task gives two numbers.
    """
    shaped = with_vector(df, columns)
    points = (chosen or farthest_points(shaped)).points
    places, place, mean = classical_scaling(_distances(points, points), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        off = all_ = 0.0
        for batch in batches:
            if batch.num_rows:
                y, d = _placed(_matrix(batch.column(0)), points, place, mean)
                off, all_ = off + float(((_distances(y, places) - d) ** 2).sum()), all_ + float((d**2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([off]), pa.array([all_])], names=["off", "whole"])

    total = shaped.select(_X).mapInArrow(run, "off double, whole double").agg(F.sum("off").alias("off"), F.sum("whole").alias("whole")).first()
    return float(np.sqrt(total.off / total.whole)) if total.whole else 0.0
