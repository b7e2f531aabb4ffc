"""Regular time grid and reductions onto it (GRD1-7, AGG1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, missing_if_nan

KEY = "stimulus_id"


def window_count(duration: Column, hop: float) -> Column:
    """GRD1: max(1, ceil(round(duration / hop, 9)))."""
    if hop <= 0:
        raise ValueError("hop must be positive")
    return F.greatest(F.lit(1), F.ceil(F.round(duration / hop, 9)).cast("int"))


def window_time(k: Column, hop: float) -> Column:
    """GRD2: centre of window k."""
    return (k + 0.5) * hop


def window_index(t: Column, hop: float, n: Column) -> Column:
    """GRD3: truncation toward zero, clamped to the grid."""
    return F.least(F.greatest((t / hop).cast("int"), F.lit(0)), n - 1)


def spine(durations: DataFrame, hop: float, key: str = KEY, duration: str = "duration") -> DataFrame:
    """(key, n, k, time): every window of every stimulus."""
    grids = durations.select(key, window_count(F.col(duration), hop).alias("n"))
    return grids.select(key, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("time", window_time(F.col("k"), hop))


def reduce_windows(
    native: DataFrame,
    durations: DataFrame,
    hop: float,
    means: tuple[str, ...] = (),
    maxes: tuple[str, ...] = (),
    sums: tuple[str, ...] = (),
    key: str = KEY,
    t: str = "t",
    duration: str = "duration",
) -> DataFrame:
    """(key, k, means, maxes, sums under their own names, _events) of the windows that hold rows.

    Rows are summed per (key, truncated time) before they meet the durations,
    map-side first: native rows are never shuffled, and a stimulus with a third
    of them is a few sums per window. Overhang folds in the second sum.
    """
    binned = native.where(F.col(t).isNotNull()).withColumn("_k", (F.col(t) / hop).cast("int"))
    value = lambda c: missing_if_nan(F.col(c))
    first = [f(value(c)).alias(f"_{n}_{c}") for c in means for n, f in (("s", F.sum), ("n", F.count))]
    first += [F.max(value(c)).alias(f"_m_{c}") for c in maxes] + [F.sum(value(c)).alias(f"_t_{c}") for c in sums]
    partial = binned.groupBy(key, "_k").agg(*first, F.count("*").alias("_e"))
    counts = durations.select(F.col(key).alias("_key"), window_count(F.col(duration), hop).alias("n"))
    placed = partial.join(counts, F.col(key) == F.col("_key")).withColumn("k", F.least(F.greatest(F.col("_k"), F.lit(0)), F.col("n") - 1))
    second = [F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(c) for c in means]
    second += [finite(F.max(f"_m_{c}")).alias(c) for c in maxes] + [F.sum(f"_t_{c}").alias(c) for c in sums]
    return placed.groupBy(key, "k").agg(*second, F.sum("_e").alias("_events"))


def to_grid(
    native: DataFrame,
    durations: DataFrame,
    hop: float,
    means: tuple[str, ...] = (),
    maxes: tuple[str, ...] = (),
    rate: str | None = None,
    key: str = KEY,
    t: str = "t",
    duration: str = "duration",
    spread: bool = False,
) -> DataFrame:
    """GRD4-6: missing-aware means, maxima and event rates on a dense grid.

    A feature with no value in a window is NULL there; a rate is 0. ``spread``: the
    grid in stated partitions, for a family that ``assemble`` joins.
    """
    copies = native.select(key, t, *[F.col(c).alias(f"{c}_mean") for c in means], *[F.col(c).alias(f"{c}_max") for c in maxes])
    reduced = reduce_windows(copies, durations, hop, tuple(f"{c}_mean" for c in means), tuple(f"{c}_max" for c in maxes), (), key, t, duration)
    windows = spine(durations, hop, key, duration)
    dense = (stated(windows, key) if spread else windows).join(reduced, [key, "k"], "left")
    rated = dense.withColumn(rate, F.coalesce(F.col("_events"), F.lit(0)) / hop) if rate else dense
    return rated.select(key, "k", "time", *[f"{c}_mean" for c in means], *[f"{c}_max" for c in maxes], *([rate] if rate else []))


def stated(grid: DataFrame, key: str = KEY) -> DataFrame:
    """``grid`` by window in ``spark.sql.shuffle.partitions`` partitions, which adaptive execution leaves alone."""
    return grid.repartition(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "k")


def assemble(spine_df: DataFrame, families: list[DataFrame], key: str = KEY) -> DataFrame:
    """GRD7: features of several families on one grid, in request order.

    All joins run in one stage, with a sort or more a family in every task. Grids
    compress so well that adaptive execution, which goes by bytes, would make that
    stage a few tasks however many rows there are, so its partitions are stated.
    """
    frames = stated(spine_df.select(key, "k", "time"), key)
    for family in families:
        frames = frames.join(family.drop("time"), [key, "k"], "left")
    return frames
