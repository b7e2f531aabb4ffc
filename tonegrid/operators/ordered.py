"""Ordered-event analytics (WIN1-12, AGG5-8, AGG12, AGG16).

``width``: how much of the first order column (seconds, words, rows) is one bucket of
a scan (``scan``), for stimuli too long for one task; None: one window a stimulus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from .grid import KEY
from .scan import BUCKET, Lag, Running, in_blocks, scan

PAUSE_SECONDS, DOWNBEAT_SECONDS = 0.5, 0.03


def longest_run(words: DataFrame, word: str, order: list[str], key: str = KEY, width: float | None = None) -> DataFrame:
    """AGG12: length of the longest run of equal words, by islands; a run may span any number of buckets."""
    marked = words.select(key, *order, F.struct(F.col(word).alias("v")).alias("_w"))
    lagged = scan(marked, key, order, width, _before=Lag("_w"))
    changes = lagged.withColumn("_change", F.when(F.col("_w").eqNullSafe(F.col("_before")), 0).otherwise(1))
    islands = scan(changes, key, order, width, _island=Running("_change"))
    return islands.groupBy(key, "_island").agg(F.count("*").alias("_n")).groupBy(key).agg(F.max("_n").alias("max_run"))


def gaps(words: DataFrame, order: list[str] | None = None, key: str = KEY, width: float | None = None) -> DataFrame:
    """Every word with ``_gap``, from the offset of the word before to its onset."""
    lagged = scan(words, key, order or ["onset", "offset"], width, _end=Lag("offset"))
    return lagged.withColumn("_gap", F.col("onset") - F.col("_end")).drop("_end", BUCKET)


def pauses(words: DataFrame, min_pause: float = PAUSE_SECONDS, order: list[str] | None = None, key: str = KEY, width: float | None = None) -> DataFrame:
    """WIN3: gaps between a word's offset and the next onset of at least ``min_pause``."""
    return gaps(words, order, key, width).where(F.col("_gap") >= min_pause).withColumnRenamed("_gap", "pause")


def speech_timing(words: DataFrame, min_pause: float = PAUSE_SECONDS, order: list[str] | None = None, key: str = KEY, width: float | None = None) -> DataFrame:
    """AGG6: words, span, rates and pauses of each stimulus."""
    timed = gaps(words, order, key, width).withColumn("_gap", F.when(F.col("_gap") >= min_pause, F.col("_gap")))
    agg = timed.groupBy(key).agg(
        F.count("*").alias("n_words"),
        F.min("onset").alias("_first"),
        F.max("offset").alias("_last"),
        F.sum(F.col("offset") - F.col("onset")).alias("_spoken"),
        F.count("_gap").alias("n_pauses"),
        F.avg("_gap").alias("_mean_pause"),
        F.max("_gap").alias("_max_pause"),
        F.coalesce(F.sum("_gap"), F.lit(0.0)).alias("_paused"),
    )
    span = F.col("_last") - F.col("_first")
    return agg.select(
        key,
        "n_words",
        half_even("_first", 3).alias("first_onset"),
        half_even(span, 3).alias("speech_span_sec"),
        half_even(F.try_divide(F.col("n_words") * 60.0, span), 2).alias("words_per_minute"),
        half_even(F.try_divide(F.col("n_words").cast("double"), F.col("_spoken")), 3).alias("articulation_rate"),
        "n_pauses",
        half_even("_mean_pause", 3).alias("mean_pause_sec"),
        half_even("_max_pause", 3).alias("max_pause_sec"),
        half_even("_paused", 3).alias("total_pause_sec"),
    )


def beat_info(beats: DataFrame, t: str = "time", downbeat: str = "is_downbeat", key: str = KEY, width: float | None = None) -> DataFrame:
    """AGG8: beats, downbeats, tempo from the median inter-beat interval (WIN4)."""
    ibi = scan(beats.select(key, t, downbeat), key, [t], width, _before=Lag(t)).withColumn("_ibi", F.col(t) - F.col("_before"))
    return ibi.groupBy(key).agg(F.count("*").alias("n_beats"), F.count_if(F.col(downbeat)).alias("n_downbeats"), half_even(F.try_divide(F.lit(60.0), F.median("_ibi")), 1).alias("tempo_bpm"))


def rolling_mean(df: DataFrame, value: str, order: str, half: int, name: str = "rolling", key: str = KEY, width: float | None = None, block: int = 65_536) -> DataFrame:
    """WIN7: centred, truncated at the edges, NULL-skipping."""
    rows, w, mine = in_blocks(df, key, [order], width, half, half, block)
    return rows.withColumn(name, F.avg(value).over(w.rowsBetween(-half, half))).where(mine).select(*[c for c in df.columns if c != name], name)


def uniform_filter(df: DataFrame, value: str, order: str, size: int, name: str = "smoothed", key: str = KEY, width: float | None = None, block: int = 65_536) -> DataFrame:
    """WIN6: centred moving average with edge values repeated; even sizes lean left.

    The repeated edges are added as weights, so no padding rows are needed: with
    b rows missing before and a after, (sum + b·first + a·last) / size. Rows are
    missing only at the edges of a stimulus, where its first or last row is also
    the first or last of the block.
    """
    before, after = size // 2, size - 1 - size // 2
    rows, w, mine = in_blocks(df, key, [order], width, before, after, block)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.count(F.lit(1)).over(w.rowsBetween(1, after)) if after else F.lit(0)
    missing_before, missing_after = F.greatest(before - F.col("_n"), F.lit(0)), F.lit(after) - ahead
    total = F.sum(value).over(w.rowsBetween(-before, after)) + missing_before * F.first(value).over(whole) + missing_after * F.last(value).over(whole)
    return rows.withColumn(name, total / size).where(mine).select(*[c for c in df.columns if c != name], name)


def zscore(value: Column, by: str = KEY) -> Column:
    """WIN12: population z-score over the stimulus, deviation floored at 1e-12."""
    w = Window.partitionBy(by)
    return (value - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(1e-12))


def minmax(value: Column, by: str = KEY) -> Column:
    """WIN12: min-max to [0, 1]; NULL where the range is 0."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.least(F.greatest(F.try_divide(value - low, high - low), F.lit(0.0)), F.lit(1.0))


def number_turns(turns: DataFrame, key: str = KEY) -> DataFrame:
    """WIN8, ORD1: turns numbered from 0 by onset, offset (and speaker, for a total order)."""
    return turns.withColumn("turn_idx", F.row_number().over(Window.partitionBy(key).orderBy("onset", "offset", "speaker")) - 1)


def speaker_time(turns: DataFrame, speaker: str = "speaker", key: str = KEY) -> DataFrame:
    """AGG7: seconds and turns of every speaker; overlapping turns of one speaker count once."""
    w = Window.partitionBy(key, speaker).orderBy("onset", "offset")
    reach = F.max("offset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("offset") - F.greatest(F.col("onset"), F.coalesce(reach, F.col("onset"))), F.lit(0.0))
    return turns.select(key, speaker, fresh.alias("_s")).groupBy(key, speaker).agg(F.sum("_s").alias("seconds"), F.count("*").alias("n_turns"))


def speaker_summary(turns: DataFrame, speaker: str = "speaker", key: str = KEY) -> DataFrame:
    """AGG7: speakers, turns and the seconds of each, one row per stimulus."""
    each = speaker_time(turns, speaker, key)
    return each.groupBy(key).agg(
        F.count("*").alias("n_speakers"), F.sum("n_turns").alias("n_turns"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(speaker).alias("k"), half_even("seconds", 3).alias("v"))))).alias("speaker_seconds")
    )


def infer_hop(frames: DataFrame, t: str = "time", default: float = 0.5, key: str = KEY, width: float | None = None) -> DataFrame:
    """AGG16: median positive step of the time column, else the default."""
    steps = scan(frames.select(key, t), key, [t], width, _before=Lag(t)).withColumn("_step", F.col(t) - F.col("_before"))
    return steps.groupBy(key).agg(F.coalesce(F.median(F.when(F.col("_step") > 0, F.col("_step"))), F.lit(default)).alias("hop"))
