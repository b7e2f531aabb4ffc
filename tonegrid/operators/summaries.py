"""Exploration summaries (AGG9-11, ORD2-3, LIM1, FLT3-4, PRJ1-4)."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import KEY


def _long(df: DataFrame, columns: list[str], kinds: dict[str, str]) -> DataFrame:
    """One row per column from a one-row frame of ``column__kind`` cells."""
    cells = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{k}`" for k in kinds) for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {cells}) as (column, {', '.join(kinds.values())})")


def ranges(df: DataFrame, columns: list[str], digits: int = 5) -> DataFrame:
    """AGG10: minimum and maximum of every column in one pass; columns without a value are left out."""
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    return _long(one, columns, {"lo": "low", "hi": "high"}).where("low is not null").select("column", F.round("low", digits).alias("low"), F.round("high", digits).alias("high"))


def top_variance(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """AGG9, ORD3: the k columns of largest sample variance, in one pass; missing variance last."""
    one = df.agg(*[F.var_samp(c).alias(f"{c}__v") for c in columns])
    return _long(one, columns, {"v": "variance"}).orderBy(F.col("variance").desc_nulls_last(), "column").limit(k)


def peak_envelope(df: DataFrame, value: str, order: str, bins: int = 1500, key: str = KEY, digits: int = 3) -> DataFrame:
    """AGG11: per bin the largest magnitude over the stimulus peak; bin edges at trunc(i·n/bins). A silent stimulus stays 0.

    ``order`` numbers the samples 0 … n-1, so a bin is arithmetic, not a range join.
    """
    sizes = df.groupBy(key).agg((F.max(order) + 1).alias("_n"), F.max(F.abs(value)).alias("_peak"))
    # sample i lies in the bin b with trunc(b·n/bins) ≤ i, that is b = ((i + 1)·bins - 1) div n
    placed = df.join(sizes, key).withColumn("bin", F.expr(f"((`{order}` + 1) * {bins} - 1) div _n"))
    peaks = placed.groupBy(key, "bin").agg(F.max(F.abs(value)).alias("_p"), F.first("_peak").alias("_peak"))
    return peaks.select(key, F.col("bin").cast("int").alias("bin"), F.round(F.coalesce(F.try_divide("_p", "_peak"), F.lit(0.0)), digits).alias("peak"))


def head_rows(df: DataFrame, order: str | list[str], n: int = 2000) -> DataFrame:
    """LIM1: the first n rows by time (a report's limit); the caller records ``df.count()``."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def sorted_bars(df: DataFrame, value: str, label: str) -> DataFrame:
    """ORD2: descending, missing as -1."""
    return df.orderBy(F.coalesce(F.col(value), F.lit(-1.0)).desc(), label)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """FLT3."""
    return df.dropna(subset=columns)


def scored_only(scores: DataFrame, item: str, score: str = "score") -> DataFrame:
    """FLT4: items with at least one score."""
    return scores.join(scores.groupBy(item).agg(F.count(score).alias("_n")).where("_n > 0").select(item), item, "left_semi")


def select_patterns(columns: list[str], patterns: list[str]) -> list[str]:
    """PRJ1, SET1: names matching glob patterns, pattern order first, each once."""
    return list(dict.fromkeys(c for p in patterns for c in columns if fnmatchcase(c, p)))


def extra_columns(columns: list[str], index: list[str], features: list[str]) -> list[str]:
    """PRJ4."""
    return [c for c in columns if c not in index and c not in features]


def is_vector_column(name: str) -> bool:
    """PRJ3: an exported vector element (exactly three digits at the end)."""
    return re.search(r"_\d{3}$", name) is not None


def play_span(time, hop: float):
    """PRJ6: what is played for a grid row: its window, from 0 on."""
    return F.greatest(F.lit(0.0), time - hop / 2), time + hop / 2


def column_pattern(columns: list[str], limit: int = 16) -> dict | None:
    """SNK10: a compact description of more than ``limit`` numbered columns of one prefix."""
    parts = [re.fullmatch(r"(.+)_(\d+)", c) for c in columns]
    if len(columns) <= limit or not all(parts) or len({m[1] for m in parts}) != 1:
        return None
    numbers = sorted(int(m[2]) for m in parts)
    width = len(parts[0][2])
    return {"pattern": f"{parts[0][1]}_{'#' * width}", "range": [numbers[0], numbers[-1]], "count": len(columns)}
