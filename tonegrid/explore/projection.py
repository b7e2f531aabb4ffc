"""Projections of feature tables (VIZ1-6).

PCA runs as Spark ML over all rows. PPCA with missing entries iterates on the
driver over sufficient statistics that executors sum; MDS is a driver routine
for at most ``MDS_MAX`` rows, which the method choice respects; ``landmarks`` scales
any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MDS_MAX = 500
#: Rows that a driver routine of an optional library takes.
OPTIONAL_MAX = 5000


def choose_method(n_rows: int, n_columns: int, trajectory: bool = False) -> str:
    """VIZ6."""
    return "pca" if trajectory or n_rows > MDS_MAX else "mds"


def dimensions(n_rows: int, n_columns: int) -> int:
    """VIZ6: three dimensions need three columns and four rows."""
    return 3 if n_columns >= 3 and n_rows >= 4 else 2


def validate(n_rows: int, n_columns: int) -> None:
    if n_rows < 3:
        raise ValueError("a projection needs at least 3 samples")
    if n_columns < 2:
        raise ValueError("a projection needs at least 2 features")


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """VIZ5: missing entries become the column mean, computed in one pass; the input is not changed."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    return df.fillna({c: m for c, m in means.items() if m is not None}, subset=columns)


def pca(df: DataFrame, columns: list[str], k: int = 2, name: str = "projection") -> tuple[DataFrame, list[float]]:
    """VIZ1: standardised principal components as an array column, and explained-variance ratios.

    The largest loading of every component is made positive, so signs are fixed.
    """
    validate(df.count(), len(columns))
    vectors = impute_mean(df, columns).withColumn("_x", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaled)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    turned = F.zip_with(vector_to_array("_p"), F.array(*[F.lit(float(s)) for s in signs]), lambda a, b: a * b)
    return model.transform(scaled).withColumn(name, turned).drop("_x", "_z", "_p"), [float(v) for v in model.explainedVariance]


def ppca(df: DataFrame, columns: list[str], k: int = 2, iterations: int = 100, tolerance: float = 1e-4, seed: int = 0, name: str = "projection") -> tuple[DataFrame, dict]:
    """VIZ2: probabilistic PCA by EM with missing entries, each row using its observed columns alone.

    A pass sums, per column, E[zz'] and E[z]x over the rows that have it: the
    driver sees matrices of the feature count, never rows.
    """
    n = df.count()
    validate(n, len(columns))
    d = len(columns)
    stats = df.agg(*[f(c).alias(f"{c}_{j}") for c in columns for j, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"{c}_m"] or 0.0 for c in columns])
    scale = np.array([stats[f"{c}_s"] or 1.0 for c in columns])
    scale[scale == 0] = 1.0
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).persist()
    rng = np.random.default_rng(seed)
    loading, noise, before = rng.standard_normal((d, k)) * 0.1, 1.0, None

    def expect(x, w, s2):
        seen = ~np.isnan(x)
        wo = w[seen]
        inverse = np.linalg.inv(wo.T @ wo + s2 * np.eye(w.shape[1]))
        z = inverse @ wo.T @ x[seen]
        return seen, z, s2 * inverse + np.outer(z, z)

    for _ in range(iterations):
        w, s2 = loading, noise

        def sums(batches: Iterator[pa.RecordBatch], w=w, s2=s2) -> Iterator[pa.RecordBatch]:
            zz, zx, xx, count = np.zeros((d, k, k)), np.zeros((d, k)), np.zeros(d), np.zeros(d)
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    v = (np.array([np.nan if e is None else e for e in x]) - mean) / scale
                    seen, z, ezz = expect(v, w, s2)
                    zz[seen] += ezz
                    zx[seen] += v[seen, None] * z
                    xx[seen] += v[seen] ** 2
                    count[seen] += 1
            flat = np.concatenate([zz.ravel(), zx.ravel(), xx, count])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

        parts = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        flat = np.array([r.v for r in parts])
        a, b, c = d * k * k, d * k * k + d * k, d * k * k + d * k + d
        zz, zx, xx, count = flat[:a].reshape(d, k, k), flat[a:b].reshape(d, k), flat[b:c], flat[c:]
        loading = np.array([np.linalg.solve(zz[j] + 1e-9 * np.eye(k), zx[j]) if count[j] else np.zeros(k) for j in range(d)])
        error = xx - 2 * (loading * zx).sum(axis=1) + np.einsum("jk,jkl,jl->j", loading, zz, loading)
        noise = max(float(error.sum() / max(count.sum(), 1)), 1e-6)
        if before is not None and abs(before - noise) < tolerance * before:
            break
        before = noise
    rows.unpersist()
    w, s2 = loading, noise

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [expect((np.array([np.nan if e is None else e for e in x]) - mean) / scale, w, s2)[1] for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], name])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    shaped = df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in columns]))
    return shaped.mapInArrow(project, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])), {"loading": loading, "noise": noise, "mean": mean, "scale": scale}


def mds(x: np.ndarray, k: int = 2, metric: bool = True, iterations: int = 300, tolerance: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """VIZ3: SMACOF from one seeded start; non-metric stress uses isotonic disparities."""
    if len(x) > MDS_MAX:
        raise ValueError(f"MDS takes at most {MDS_MAX} rows; use landmarks or PCA")
    validate(len(x), x.shape[1])
    n = len(x)
    target = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    y = np.random.default_rng(seed).uniform(size=(n, k))
    upper = np.triu_indices(n, 1)
    order = np.argsort(target[upper], kind="stable")
    before = None
    for _ in range(iterations):
        dist = np.sqrt(np.maximum(((y[:, None] - y[None]) ** 2).sum(axis=2), 0))
        goal = target
        if not metric:
            fitted = isotonic(dist[upper][order])
            flat = np.empty_like(fitted)
            flat[order] = fitted * np.sqrt(len(fitted) / max((fitted**2).sum(), 1e-12))
            goal = np.zeros((n, n))
            goal[upper] = flat
            goal += goal.T
        stress = float(((dist - goal)[upper] ** 2).sum())
        ratio = np.divide(goal, dist, out=np.zeros_like(goal), where=dist > 1e-12)
        b = -ratio
        b[np.arange(n), np.arange(n)] = ratio.sum(axis=1)
        y = b @ y / n
        if before is not None and before - stress < tolerance * max(before, 1e-12):
            break
        before = stress
    return y, stress


def isotonic(values: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v in values:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, n in blocks]) if blocks else np.zeros(0)


def optional_projection(x: np.ndarray, method: str, k: int = 2, seed: int = 0) -> np.ndarray:
    """VIZ4: t-SNE or UMAP of standardised rows by their libraries, where they are installed."""
    if len(x) > OPTIONAL_MAX:
        raise ValueError(f"{method} takes at most {OPTIONAL_MAX} rows; use PCA")
    validate(len(x), x.shape[1])
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(scale > 0, scale, 1)
    try:
        if method == "tsne":
            from sklearn.manifold import TSNE

            return TSNE(n_components=k, perplexity=min(30, len(z) - 1), random_state=seed).fit_transform(z)
        from umap import UMAP

        return UMAP(n_components=k, random_state=seed).fit_transform(z)
    except ImportError as e:
        raise ValueError(f"{method} needs an optional library that is not installed ({e.name})") from e


def project(df: DataFrame, columns: list[str], method: str = "pca", k: int = 2) -> DataFrame:
    """VIZ5: one entry for all methods; optional libraries are named when absent."""
    if method == "pca":
        return pca(df, columns, k)[0]
    if method == "ppca":
        return ppca(df, columns, k)[0]
    if method == "landmarks":
        from .landmarks import landmark_mds

        return landmark_mds(df, columns, k)[0]
    if method in ("mds", "nmds"):
        rows = impute_mean(df, columns).limit(MDS_MAX + 1).toPandas()
        y, _ = mds(rows[columns].to_numpy(dtype=float), k, method == "mds")
        rows["projection"] = [list(map(float, r)) for r in y]
        return df.sparkSession.createDataFrame(rows)
    if method in ("tsne", "umap"):
        rows = impute_mean(df, columns).limit(OPTIONAL_MAX + 1).toPandas()
        y = optional_projection(rows[columns].to_numpy(dtype=float), method, k)
        rows["projection"] = [list(map(float, r)) for r in y]
        return df.sparkSession.createDataFrame(rows)
    raise ValueError(f"unknown projection method {method!r}")
