"""Embedding operators (EMB1-11, JON10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise, probe
from .grid import KEY


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def ensemble_bank(vectors: DataFrame, category: str, vector: str, name: str = "bank") -> DataFrame:
    """EMB2: mean of unit vectors per category, normalised again.

    Averages are per (category, position), so a category of any size is summed
    map-side; only one vector per category is assembled.
    """
    unit = vectors.select(category, F.posexplode(l2_normalise(F.col(vector))).alias("_pos", "_x"))
    means = unit.groupBy(category, "_pos").agg(F.avg("_x").alias("_m"))
    whole = means.groupBy(category).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("_v"))
    return whole.select(category, l2_normalise(F.col("_v")).alias(name))


#: Rows of a bank that are sent to every executor at once; larger banks go in blocks.
MAX_BANK_ROWS = 4096


def cosine_bank(vectors: DataFrame, bank: DataFrame, vector: str = "embedding", category: str = "category", name: str = "bank") -> DataFrame:
    """EMB3: raw cosine of every vector with every bank row, in long form (no softmax).

    The bank is sent as one array value of at most ``MAX_BANK_ROWS`` rows, so a
    block is a narrow projection and no join; a larger bank takes several blocks.
    """
    parts = max(1, -(-bank.count() // MAX_BANK_ROWS))
    unit = vectors.withColumn("_unit", l2_normalise(F.col(vector)))
    out = None
    for part in range(parts):
        mine = bank.where(F.pmod(F.xxhash64(category), F.lit(parts)) == part) if parts > 1 else bank
        packed = mine.agg(F.array_sort(F.collect_list(F.struct(F.col(category).alias("category"), F.col(name).alias("bank")))).alias("_banks"))
        scored = unit.join(F.broadcast(packed)).withColumn("_b", F.explode("_banks"))
        scored = scored.select(*vectors.columns, F.col("_b.category").alias(category), dot(F.col("_unit"), F.col("_b.bank")).alias("score"))
        out = scored if out is None else out.unionAll(scored)
    return out


def pivot_scores(scores: DataFrame, row_key: list[str], category: str, names: list, score: str = "score", prefix: str = "") -> DataFrame:
    """EMB3: one column per category."""
    return scores.groupBy(*row_key).agg(*[F.max(F.when(F.col(category) == n, F.col(score))).alias(f"{prefix}{n}") for n in names])


def linear_probe(vectors: DataFrame, vector: str, coefficients: dict[str, tuple[list[float], float]]) -> DataFrame:
    """EMB4: one clipped read-out per named dimension; coefficients are literals of the plan."""
    return vectors.select("*", *[probe(F.col(vector), F.array(*[F.lit(float(c)) for c in coef]), F.lit(float(b))).alias(name) for name, (coef, b) in coefficients.items()])


def rank_margin(scores: DataFrame, item: str, category: str, score: str = "score", alike: str | None = None) -> DataFrame:
    """EMB10: best item of every category and its margin over the second; gated (NULL) scores do not compete.

    ``alike``: a column whose equal values mark interchangeable items (two alarms
    for one category): none of them is the other's second. Two maxima by partial
    aggregation instead of a window over each category.
    """
    group = F.col(alike) if alike else F.col(item)
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i"), group.alias("g")))
    top = scores.where(F.col(score).isNotNull()).groupBy(category).agg(best.alias("_b"))
    other = ~F.coalesce(group == F.col("_b.g"), F.col(item) == -F.col("_b.i"))
    rest = scores.join(top, category).where(F.col(score).isNotNull() & other).groupBy(category).agg(F.max(score).alias("_second"))
    return top.join(rest, category, "left").select(category, (-F.col("_b.i")).alias(item), F.col("_b.s").alias("best_score"), (F.col("_b.s") - F.col("_second")).alias("margin"))


def top_profile(scores: DataFrame, item: str, category: str, n: int = 5, score: str = "score") -> DataFrame:
    """EMB11: the n best categories of every item."""
    w = Window.partitionBy(item).orderBy(F.col(score).desc_nulls_last(), F.col(category))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def group_folds(rows: DataFrame, group: str, n_folds: int = 5) -> DataFrame:
    """EMB8: fold of every row by a hash of its group, so a group is never split."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(n_folds)).cast("int"))


#: Side of the tiles in which matrices of moments travel.
TILE = 64


def gram_tiles(rows: DataFrame, features: str, target: str, by: str | None = None, tile: int = TILE) -> DataFrame:
    """EMB7: (fold, i, j, cells): tiles of the moments V'V of v = (features, target, 1), on and above the diagonal.

    A task adds its rows up fold by fold, an Arrow batch at a time, and sends
    each tile once; tiles are added by key in two steps (the first one salted), so
    what is shuffled depends on tasks, folds and dimensions, not on rows. Rows
    with a NULL vector, entry, target or fold are left out.
    """
    size = F.size(features)
    whole = rows.where(F.col(features).isNotNull() & F.col(target).isNotNull() & ~F.exists(F.col(features), lambda x: x.isNull()))
    narrow = whole.select((F.col(by) if by else F.lit(0)).cast("int").alias("fold"), F.transform(F.col(features), lambda x: x.cast("double")).alias("x"), F.col(target).cast("double").alias("y"), size.alias("n")).where("fold is not null")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(3).to_numpy()
            if sizes.min() != sizes.max():
                raise ValueError("vectors of one length are needed")
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            v = np.concatenate([x, batch.column(2).to_numpy()[:, None], np.ones((batch.num_rows, 1))], axis=1)
            folds = batch.column(0).to_numpy()
            for fold in np.unique(folds).tolist():
                part = v[folds == fold]
                known = sums.setdefault(fold, np.zeros((v.shape[1], v.shape[1])))
                if known.shape[0] != v.shape[1]:
                    raise ValueError("vectors of one length are needed")
                known += part.T @ part
        salt = partition_id() % 64
        for fold, m in sums.items():
            for i in range(0, len(m), tile):
                for j in range(i, len(m), tile):
                    cells = np.ascontiguousarray(m[i : i + tile, j : j + tile])
                    yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([cells.shape[1]], pa.int32()), pa.array([salt], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["fold", "i", "j", "width", "salt", "cells"])

    def added(salted: bool):
        def add(part: pa.Table) -> pa.Table:
            total = np.zeros(len(part["cells"][0].as_py()) // 8)
            for chunk in part["cells"].chunks:
                for cell in chunk:
                    total += np.frombuffer(cell.as_py())
            keep = ["fold", "i", "j", "width"] + (["salt"] if salted else [])
            return part.select(keep).slice(0, 1).append_column("cells", pa.array([total.tobytes()], pa.binary()))

        return add

    schema = "fold int, i int, j int, width int, salt int, cells binary"
    sums = narrow.mapInArrow(partial, schema).groupBy("fold", "i", "j", "salt").applyInArrow(added(True), schema)
    return sums.groupBy("fold", "i", "j").applyInArrow(added(False), "fold int, i int, j int, width int, cells binary")


def ridge_moments(rows: DataFrame, features: str, target: str, by: str | None = None, tile: int = TILE) -> DataFrame:
    """Sufficient statistics of a ridge fit as long-form sums: (fold, i, j, value), j >= i, dimensions of the vector only."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                fold, i, j, width = (batch.column(c)[k].as_py() for c in range(4))
                m = np.frombuffer(batch.column(4)[k].as_py()).reshape(-1, width)
                a, b = (x.ravel() for x in np.mgrid[i : i + m.shape[0], j : j + width])
                keep = b >= a
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), fold, np.int32)), pa.array(a[keep].astype(np.int32)), pa.array(b[keep].astype(np.int32)), pa.array(m.ravel()[keep])], names=["fold", "i", "j", "value"])

    return gram_tiles(rows, features, target, by, tile).mapInArrow(cells, "fold int, i int, j int, value double")


class Ridge:
    """Fits and errors from the moments of each fold: matrices of the vector's size on the driver, never rows."""

    def __init__(self, tiles: DataFrame):
        parts = tiles.collect()
        size = max(r.j + r.width for r in parts)
        self.folds: dict[int, np.ndarray] = {}
        for r in parts:
            m = self.folds.setdefault(r.fold, np.zeros((size, size)))
            cells = np.frombuffer(r.cells).reshape(-1, r.width)
            m[r.i : r.i + cells.shape[0], r.j : r.j + r.width] = cells
            m[r.j : r.j + r.width, r.i : r.i + cells.shape[0]] = cells.T
        self.whole, self.d = sum(self.folds.values()), size - 2

    def solve(self, m: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients and intercept; the intercept is not penalised."""
        d, n = self.d, m[-1, -1]
        mean_x, mean_y = m[:d, -1] / n, m[d, -1] / n
        cov = m[:d, :d] - n * np.outer(mean_x, mean_x)
        coef = np.linalg.solve(cov + alpha * np.eye(d), m[:d, d] - n * mean_x * mean_y)
        return coef, float(mean_y - mean_x @ coef)

    def without(self, fold: int, alpha: float) -> tuple[np.ndarray, float]:
        """The fit that has not seen a fold (with one fold only, the fit of all)."""
        return self.solve(self.whole - self.folds[fold] if len(self.folds) > 1 else self.whole, alpha)

    def error(self, fold: int, alpha: float) -> float:
        """Squared errors of a fold by the fit without it, summed."""
        coef, b = self.without(fold, alpha)
        v = np.concatenate([-coef, [1.0, -b]])
        return float(v @ self.folds[fold] @ v)

    def path(self, alphas: list[float]) -> list[tuple[float, int, int, float]]:
        """(alpha, fold, rows, squared error) of every penalty and fold."""
        return [(a, f, int(m[-1, -1]), self.error(f, a)) for a in alphas for f, m in sorted(self.folds.items())]

    def choose(self, alphas: list[float]) -> float:
        """The penalty of least error over all folds; the smaller one of equals."""
        return min(alphas, key=lambda a: (sum(self.error(f, a) for f in self.folds), a))


def ridge_fit(rows: DataFrame, features: str, target: str, alphas: list[float], group: str | None = None, n_folds: int = 5) -> dict:
    """EMB7: ridge regression with the penalty chosen by grouped cross-validation.

    One pass gives the moments of every fold (a matrix of the vector's size, not
    of the data); fits and their errors follow from sums of those matrices.
    """
    fit = Ridge(gram_tiles(group_folds(rows, group, n_folds) if group else rows.withColumn("fold", F.lit(0)), features, target, "fold"))
    alpha = fit.choose(alphas)
    coef, b = fit.solve(fit.whole, alpha)
    n = int(fit.whole[-1, -1])
    return {"alpha": alpha, "coef": coef.tolist(), "intercept": b, "cv_rmse": (sum(fit.error(f, alpha) for f in fit.folds) / n) ** 0.5, "n": n}


def out_of_fold(rows: DataFrame, features: str, fold: str, fit: Ridge, alpha: float, name: str = "guess") -> DataFrame:
    """EMB8: every row's prediction by the fit that has not seen its fold; coefficients are literals of the plan."""
    guess = F.lit(None).cast("double")
    for f in sorted(fit.folds):
        coef, b = fit.without(f, alpha)
        guess = F.when(F.col(fold) == f, dot(F.col(features), F.array(*[F.lit(float(c)) for c in coef])) + F.lit(b)).otherwise(guess)
    return rows.withColumn(name, guess)


def evaluation(rows: DataFrame, truth: str, guess: str, group: str, min_rows: int = 3, min_std: float = 1e-9) -> DataFrame:
    """EMB9: pooled r, RMSE, and the mean r within groups of more than ``min_rows`` rows that vary."""
    pooled = rows.agg(F.count("*").alias("n"), F.corr(truth, guess).alias("pooled_r"), F.sqrt(F.avg((F.col(truth) - F.col(guess)) ** 2)).alias("rmse"))
    within = rows.groupBy(group).agg(F.count("*").alias("n"), F.stddev_pop(truth).alias("st"), F.stddev_pop(guess).alias("sg"), F.corr(truth, guess).alias("r"))
    within = within.where((F.col("n") > min_rows) & (F.col("st") > min_std) & (F.col("sg") > min_std)).agg(F.avg("r").alias("mean_within_r"), F.count("*").alias("n_groups"))
    return pooled.join(F.broadcast(within))  # one row each


def annotation_pairs(valence: DataFrame, arousal: DataFrame, durations: DataFrame, stride: float = 2.0, margin: float = 0.25, song: str = "song_id") -> DataFrame:
    """JON10: both annotations at strided times that end before the song does."""
    both = valence.select(song, "t", F.col("value").alias("valence")).join(arousal.select(song, "t", F.col("value").alias("arousal")), [song, "t"])
    timed = both.join(durations.select(song, "duration"), song)
    return timed.where((F.col("t") % stride == 0) & (F.col("t") <= F.col("duration") - margin) & F.col("valence").isNotNull() & F.col("arousal").isNotNull()).drop("duration")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("DataFrame", "Window", "F", "KEY", "Iterator", "annotations", "np", "pa")]
