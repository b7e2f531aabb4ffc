"""Beats and downbeats (JON4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import KEY
from .intervals import near_points
from .ordered import DOWNBEAT_SECONDS


def downbeats(beats: DataFrame, marks: DataFrame | None, tolerance: float = DOWNBEAT_SECONDS, key: str = KEY) -> DataFrame:
    """(key, time, is_downbeat): beats strictly nearer than ``tolerance`` to a mark; without marks, ``is_downbeat`` as given."""
    if marks is None:
        return beats if "is_downbeat" in beats.columns else beats.withColumn("is_downbeat", F.lit(False))
    hits = near_points(beats, marks, tolerance, t="time", key=key).select(key, "time").distinct().withColumn("_hit", F.lit(True))
    return beats.drop("is_downbeat").join(hits, [key, "time"], "left").withColumn("is_downbeat", F.coalesce("_hit", F.lit(False))).drop("_hit")
