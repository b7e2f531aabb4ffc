"""Interval, point and nearest joins inside a stimulus (JON1-5, JON8-9, TXT6-7, TXT9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, voice_gender
from .grid import KEY


def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width), F.greatest(F.floor(low / width), F.floor(high / width)))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, key: str = KEY) -> DataFrame:
    """Pairs of intervals of the same stimulus that touch (closed ends), as an equi-join.

    Both sides are exploded into buckets of ``width`` seconds; a pair is kept in
    the later of the two first buckets only, so no pair repeats and no distinct
    is needed. Right-hand columns other than the key come with prefix ``r_``.
    """
    (lo, lf), (ro, rf) = left_span, right_span
    a = left.withColumn("_b", F.explode(_buckets(F.col(lo), F.col(lf), width))).withColumn("_first", F.floor(F.col(lo) / width))
    b = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    b = b.withColumn("_b", F.explode(_buckets(F.col(f"r_{ro}"), F.col(f"r_{rf}"), width))).withColumn("_r_first", F.floor(F.col(f"r_{ro}") / width))
    pairs = a.join(b, [key, "_b"]).where(F.col("_b") == F.greatest("_first", "_r_first"))
    return pairs.where((F.col(lo) <= F.col(f"r_{rf}")) & (F.col(f"r_{ro}") <= F.col(lf))).drop("_b", "_first", "_r_first")


def majority_speaker(segments: DataFrame, turns: DataFrame, width: float = 10.0, segment: str = "segment_idx", key: str = KEY) -> DataFrame:
    """JON1: speaker with the largest summed overlap; ties to the first by name; none gives ''."""
    pairs = interval_join(segments.select(key, segment, "onset", "offset"), turns.select(key, "speaker", "onset", "offset"), ("onset", "offset"), ("onset", "offset"), width, key)
    overlap = F.least("offset", "r_offset") - F.greatest("onset", "r_onset")
    sums = pairs.where(overlap > 0).groupBy(key, segment, F.col("r_speaker").alias("speaker")).agg(F.sum(overlap).alias("_overlap"))
    best = sums.groupBy(key, segment).agg(F.min(F.struct((-F.col("_overlap")).alias("o"), "speaker")).alias("_best")).select(key, segment, F.col("_best.speaker").alias("speaker"))
    return segments.drop("speaker").join(best, [key, segment], "left").withColumn("speaker", F.coalesce("speaker", F.lit("")))


def point_owner(points: DataFrame, turns: DataFrame, at: str, point_id: str, owner: str = "speaker", order: str = "turn_idx", width: float = 10.0, key: str = KEY) -> DataFrame:
    """JON2, JON9: first interval in order with onset ≤ t < offset; none gives ''."""
    points = points.drop(owner)  # an earlier answer is replaced
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    t = turns.select(F.col(key), F.col(owner).alias("_owner"), F.col(order).alias("_order"), F.col("onset").alias("_on"), F.col("offset").alias("_off")).withColumn("_b", F.explode(_buckets(F.col("_on"), F.col("_off"), width)))
    hit = p.select(key, point_id, "_b", at).join(t, [key, "_b"]).where((F.col("_on") <= F.col(at)) & (F.col(at) < F.col("_off")))
    first = hit.groupBy(key, point_id).agg(F.min(F.struct("_order", "_owner")).alias("_m")).select(key, point_id, F.col("_m._owner").alias(owner))
    return points.join(first, [key, point_id], "left").withColumn(owner, F.coalesce(owner, F.lit("")))


def word_speakers(words: DataFrame, turns: DataFrame, word_id: str = "word_idx", width: float = 10.0, key: str = KEY) -> DataFrame:
    """JON2 on word midpoints."""
    return point_owner(words.withColumn("_mid", (F.col("onset") + F.col("offset")) / 2), turns, "_mid", word_id, width=width, key=key).drop("_mid")


def segment_voice(segments: DataFrame, frames: DataFrame, hop: float, f0: str = "pitch_f0", width: float = 10.0, segment: str = "segment_idx", key: str = KEY) -> DataFrame:
    """JON3, TXT6: median f0 of the frames inside each segment (± half a hop, closed), and the voice class."""
    wide = segments.select(key, segment, (F.col("onset") - hop / 2).alias("_lo"), (F.col("offset") + hop / 2).alias("_hi"))
    points = frames.select(key, F.col("time").alias("a"), F.col("time").alias("z"), F.col(f0).alias("f0"))
    pairs = interval_join(wide, points, ("_lo", "_hi"), ("a", "z"), width, key)
    medians = pairs.groupBy(key, segment).agg(F.median("r_f0").alias("_median"))
    joined = segments.join(medians, [key, segment], "left")
    return joined.withColumn("voice_gender", voice_gender(F.col("_median"))).withColumn("median_f0", half_even(F.round("_median", 9), 1)).drop("_median")


def near_points(left: DataFrame, right: DataFrame, tolerance: float, t: str = "t", key: str = KEY) -> DataFrame:
    """JON4: left points with a right point strictly nearer than ``tolerance`` (semi-join over neighbouring buckets)."""
    bucket = lambda c: F.floor(c / tolerance)
    spread = right.select(F.col(key).alias("_rk"), F.col(t).alias("_rt"), F.explode(F.array(bucket(F.col(t)) - 1, bucket(F.col(t)), bucket(F.col(t)) + 1)).alias("_rb"))
    near = (F.col(key) == F.col("_rk")) & (bucket(F.col(t)) == F.col("_rb")) & (F.abs(F.col(t) - F.col("_rt")) < tolerance)
    return left.join(spread, near, "left_semi")


def nearest_frame(points: DataFrame, grids: DataFrame, hop: float, t: str = "t", key: str = KEY) -> DataFrame:
    """JON8: nearest window centre of a regular grid, the earlier one on ties; no join per frame is needed."""
    k = F.ceil((F.col(t) - hop / 2) / hop - 0.5).cast("int")
    return points.join(grids.select(key, "n"), key).withColumn("k", F.least(F.greatest(k, F.lit(0)), F.col("n") - 1)).drop("n")


def transcript_gaps(words: DataFrame, other: DataFrame, min_gap: float, width: float = 30.0, key: str = KEY) -> DataFrame:
    """TXT9: silent stretches of ``min_gap`` seconds in one transcript that hold words of another."""
    order = Window.partitionBy(key).orderBy("onset", "offset")
    gaps = words.withColumn("_next", F.lead("onset").over(order)).where(F.col("_next") - F.col("offset") >= min_gap).select(key, F.col("offset").alias("gap_start"), F.col("_next").alias("gap_end"))
    pairs = interval_join(gaps, other.select(key, "onset", "offset"), ("gap_start", "gap_end"), ("onset", "offset"), width, key)
    inside = pairs.where((F.col("r_onset") >= F.col("gap_start")) & (F.col("r_offset") <= F.col("gap_end")))
    return inside.groupBy(key, "gap_start", "gap_end").agg(F.count("*").alias("n_words"))
