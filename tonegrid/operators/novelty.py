"""Novelty of a sequence of vectors by a checkerboard along its self-similarity (FRM8, WIN11), as DataFrame algebra.

A checkerboard that is an outer product g·gᵀ makes the novelty of block i the
squared length of ``Σ g(o) · u(i + o)`` over unit block vectors u, so only a band
of ``2 * half`` blocks meets, never the matrix. Blocks are means by key; z-scores
take one row of statistics per stimulus and dimension; the band is a frame over
equal blocks of rows (``scan.in_blocks``) with edge vectors repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .grid import KEY
from .scan import in_blocks, numbered


def checkerboard(half: int) -> list[float]:
    """The taper whose outer product with itself is the Gaussian checkerboard."""
    return [math.exp(-0.5 * ((o + 0.5) / (half / 2)) ** 2) * (1 if o >= 0 else -1) for o in range(-half, half)]


def block_vectors(frames: DataFrame, vector: str, order: list[str], step: int, key: str = KEY, width: float = 3600.0) -> DataFrame:
    """(key, block, u): unit z-scores of the means of ``step`` frames; frames behind the last whole block are left out."""
    placed = numbered(frames.select(key, *order, vector), key, order, width, "_f").select(key, F.floor(F.col("_f") / step).cast("int").alias("block"), F.posexplode(vector).alias("_pos", "_x"))
    means = placed.groupBy(key, "block", "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_c")).where((F.col("_c") == step) | ((F.col("block") == 0) & (F.col("_c") < step)))
    stats = means.groupBy(F.col(key).alias("_k"), F.col("_pos").alias("_p")).agg(F.avg("_m").alias("_mean"), F.stddev_pop("_m").alias("_std"))
    z = means.join(stats, means[key].eqNullSafe(stats["_k"]) & (means["_pos"] == stats["_p"])).select(key, "block", "_pos", ((F.col("_m") - F.col("_mean")) / F.greatest("_std", F.lit(1e-12))).alias("_z"))
    whole = z.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_z"))), lambda s: s["_z"]).alias("_v"))
    norm = F.greatest(F.sqrt(dot(F.col("_v"), F.col("_v"))), F.lit(1e-12))
    return whole.select(key, "block", F.transform("_v", lambda x: x / norm).alias("u"))


def novelty(frames: DataFrame, vector: str, order: list[str], step: int, half: int, key: str = KEY, width: float = 3600.0, rows: int = 4096) -> DataFrame:
    """(key, block, novelty): how unlike the ``half`` blocks before a block's start are to those from it on."""
    units = block_vectors(frames, vector, order, step, key, width)
    banded, w, mine = in_blocks(units, key, ["block"], 65_536, half, half - 1, rows)
    taper = checkerboard(half)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.collect_list("u").over(w.rowsBetween(-half, half - 1))
    ahead = F.count(F.lit(1)).over(w.rowsBetween(1, half - 1)) if half > 1 else F.lit(0)
    edged = banded.select(
        key, "block", mine.alias("_mine"), near.alias("_near"), F.first("u").over(whole).alias("_first"), F.last("u").over(whole).alias("_last"),
        F.greatest(half - F.col("_n"), F.lit(0)).cast("int").alias("_before"), (half - 1 - ahead).cast("int").alias("_after"),
    ).where("_mine")
    band = F.concat(F.array_repeat("_first", F.col("_before")), F.col("_near"), F.array_repeat("_last", F.col("_after")))
    weights = F.array(*[F.lit(g) for g in taper])
    padded = edged.select(key, "block", band.alias("_band"))

    def add(acc: Column, pair: Column) -> Column:
        return F.zip_with(acc, pair["u"], lambda a, x: a + pair["g"] * x)

    pairs = F.zip_with("_band", weights, lambda u, g: F.struct(u.alias("u"), g.alias("g")))
    summed = padded.select(key, "block", F.aggregate(pairs, F.transform(F.col("_band")[0], lambda x: F.lit(0.0)), add).alias("_s"))
    return summed.select(key, "block", (dot(F.col("_s"), F.col("_s")) / sum(abs(g) for g in taper) ** 2).alias("novelty"))
