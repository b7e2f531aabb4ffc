"""Clamped context windows and gates (CTX1-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import db_to_amplitude
from .grid import KEY

SILENCE_DBFS, SPEECH_FRACTION, SHARPNESS_SONE = -80.0, 0.25, 0.25


def context_start(centre: Column, width: float, duration: Column) -> Column:
    """CTX1: window of ``width`` around a centre, pushed inside [0, duration]."""
    return F.least(F.greatest(centre - width / 2, F.lit(0.0)), F.greatest(duration - width, F.lit(0.0)))


#: Values under ``_EXACT_BELOW`` are summed as whole multiples of 1 / ``_PARTS`` and a rest.
_PARTS, _EXACT_BELOW = float(1 << 24), 1e9


def _split(v: Column) -> tuple[Column, Column]:
    """(whole, rest): whole / _PARTS + rest is the value; sums of the first are exact, and differences of such sums too."""
    whole = F.when(F.abs(v) < _EXACT_BELOW, F.floor(v * _PARTS)).otherwise(F.lit(0).cast("long"))
    return F.when(v.isNotNull(), whole).cast("decimal(18,0)"), v - whole.cast("double") / _PARTS


def context_stats(native: DataFrame, spine_df: DataFrame, durations: DataFrame, width: float, value: str, key: str = KEY, t: str = "t") -> DataFrame:
    """CTX2-4: count, mean and RMS of ``value`` over the clamped context of every grid row.

    Prefix sums: values fall into buckets of the context width, and the two
    bounds of a context are rows among them. A running sum inside a bucket is
    known at each bound, and a context reaches from one bucket into the next at
    most, so its sums are differences of two bounds. Every value is shuffled
    once, however many contexts it lies in. Differences of sums of doubles would
    keep the rounding of all values before; sums are exact down to 2^-24, so a mean
    that is a gate's threshold is that threshold.
    """
    rows = spine_df.join(durations.select(key, F.col("duration").alias("_duration")), key)
    rows = rows.withColumn("_from", context_start(F.col("time"), width, F.col("_duration"))).withColumn("_to", F.col("_from") + width)
    bucket = lambda x: F.floor(x / width)
    crosses = bucket(F.col("_from")) != bucket(F.col("_to"))
    bound = lambda at, sign, whole: F.struct(F.col(at).alias("t"), bucket(F.col(at)).alias("bucket"), F.lit(sign).alias("sign"), whole.alias("whole"))
    bounds = rows.select(key, "k", F.explode(F.array(bound("_from", -1, crosses.cast("int")), bound("_to", 1, F.lit(0)))).alias("_b"))
    bounds = bounds.select(key, "k", F.col("_b.t").alias("_t"), F.col("_b.bucket").alias("_bucket"), F.col("_b.sign").alias("_sign"), F.col("_b.whole").alias("_whole"), F.lit(None).cast("double").alias("_v"))
    values = native.select(F.col(key), F.lit(None).cast("int").alias("k"), F.col(t).cast("double").alias("_t"), bucket(F.col(t)).alias("_bucket"), F.lit(0).alias("_sign"), F.lit(0).alias("_whole"), F.col(value).cast("double").alias("_v"))
    part = Window.partitionBy(key, "_bucket")
    upto = part.orderBy("_t", F.abs("_sign").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a bound stands before the values at its own time
    halves = {n: _split(v) for n, v in (("_s", F.col("_v")), ("_q", F.col("_v") * F.col("_v")))}
    columns = {"_n": F.count("_v")} | {f"{n}{i}": F.sum(half) for n, both in halves.items() for i, half in enumerate(both)}
    summed = bounds.unionByName(values).select(key, "k", "_sign", "_whole", *[(F.col("_sign") * F.coalesce(f.over(upto), F.lit(0)) + F.col("_whole") * F.coalesce(f.over(part), F.lit(0))).alias(n) for n, f in columns.items()])
    stats = summed.where("k is not null").groupBy(key, "k").agg(*[F.sum(n).alias(n) for n in columns])
    stats = stats.select(key, "k", "_n", *[(F.col(f"{n}0").cast("double") / _PARTS + F.col(f"{n}1")).alias(n) for n in halves])
    some = F.col("_n") > 0
    stats = stats.select(key, "k", F.col("_n").alias("n_values"), F.when(some, F.col("_s") / F.col("_n")).alias("context_mean"), F.when(some, F.sqrt(F.greatest(F.col("_q"), F.lit(0.0)) / F.col("_n"))).alias("context_rms"))
    return spine_df.select(key, "k", "time").join(stats, [key, "k"], "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))


def is_silent(rms: Column, dbfs: float = SILENCE_DBFS) -> Column:
    """CTX3: RMS of the context strictly under the gate; an empty context is silent."""
    return F.coalesce(rms, F.lit(0.0)) < db_to_amplitude(F.lit(dbfs))


def gate(value: Column, open_: Column) -> Column:
    """CTX5-7: the value where the gate is open (true), else NULL; a NULL condition closes it."""
    return F.when(open_, value)


def speech_gate(value: Column, fraction: Column) -> Column:
    return gate(value, fraction >= SPEECH_FRACTION)


def sharpness_gate(value: Column, loudness: Column) -> Column:
    return gate(value, loudness >= SHARPNESS_SONE)


def zero_is_missing(value: Column) -> Column:
    """CTX8."""
    return F.nullif(value, F.lit(0.0))


def gated_counts(frames: DataFrame, gates: dict[str, Column], key: str = KEY) -> DataFrame:
    """CTX9: windows closed by each gate, per stimulus."""
    return frames.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in gates.items()])
