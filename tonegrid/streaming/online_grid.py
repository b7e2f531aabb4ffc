"""Online grid: the grid reductions over an unbounded stream of timed values (§2.15)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.scalars import missing_if_nan, normalise_word


def online_grid(stream: DataFrame, hop_seconds: float, ts: str = "ts", value: str = "value", key: str = "stimulus_id", late: str = "10 minutes") -> DataFrame:
    """Tumbling mean, maximum and rate per stimulus; late rows are taken until the watermark passes.

    ``ts`` may be a timestamp without zone: it is cast first, as watermarks need
    zoned timestamps. Empty windows do not appear in a stream; the batch spine
    adds them when the result is read.
    """
    width = f"{int(round(hop_seconds * 1000))} milliseconds"
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    grouped = timed.groupBy(F.window("_ts", width), F.col(key)).agg(F.avg(missing_if_nan(F.col(value))).alias("mean"), F.max(missing_if_nan(F.col(value))).alias("max"), F.count("*").alias("n"))
    return grouped.select(key, F.col("window.start").alias("window_start"), "mean", "max", (F.col("n") / hop_seconds).alias("rate"))


def online_context(stream: DataFrame, width_seconds: float, hop_seconds: float, ts: str = "ts", value: str = "value", key: str = "stimulus_id", late: str = "10 minutes") -> DataFrame:
    """Sliding context mean (unclamped at the ends, unlike the batch operator)."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    window = F.window("_ts", f"{int(width_seconds * 1000)} milliseconds", f"{int(hop_seconds * 1000)} milliseconds")
    return timed.groupBy(window, F.col(key)).agg(F.avg(missing_if_nan(F.col(value))).alias("context_mean")).select(key, F.col("window.start").alias("context_start"), "context_mean")


def _in_order(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """All rows of a key in a trigger, in order (they may come in several pieces)."""
    return pd.concat(list(batches)).sort_values(order, kind="stable")


def online_pauses(stream: DataFrame, min_pause: float = 0.5, key: str = "stimulus_id") -> DataFrame:
    """WIN3 on a stream of words (key, onset, offset).

    State per stimulus is one number, the last offset, so it stays small. Words
    of a trigger are sorted; a word that arrives in a later trigger than its
    successor is measured from that successor, so the source has to keep the
    order of a stimulus (a log partitioned by key does).
    """

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        words = _in_order(batches, "onset")
        before = words["offset"].shift(1)
        if last is not None:
            before.iloc[0] = last
        gap = words["onset"] - before
        hit = gap >= min_pause
        state.update((float(words["offset"].iloc[-1]),))
        yield pd.DataFrame({key: k[0], "onset": words["onset"][hit], "pause": gap[hit]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, onset double, pause double", "last double", "append", GroupStateTimeout.NoTimeout)


def online_recall(stream: DataFrame, pool: DataFrame, key: str = "stimulus_id", pos: str = "pos") -> DataFrame:
    """STR4: WIN1-2 on a stream of spoken words (key, pos, word, onset): pool index, repetition, inter-response time.

    Words meet the pool by an exact equi-join with the static table. State per
    stimulus: the last matched onset and the items recalled so far, which the
    pool bounds. Order within a stimulus as for ``online_pauses``.
    """
    first = pool.select("pool_index", normalise_word(F.col("item")).alias("norm")).groupBy("norm").agg(F.min("pool_index").alias("pool_index"))
    matched = stream.select(key, pos, "onset", normalise_word(F.col("word")).alias("norm")).join(first, "norm", "left").select(key, pos, "onset", F.coalesce("pool_index", F.lit(-1)).cast("int").alias("pool_index"))

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, known = state.get if state.exists else (None, [])
        words, seen = _in_order(batches, pos), {*known}
        repeated, irt = [], []
        for index, onset in zip(words["pool_index"], words["onset"], strict=True):
            hit = index >= 0
            repeated.append(bool(hit and index in seen))
            irt.append(None if not hit or last is None else round(onset - last, 3))
            if hit:
                seen.add(int(index))
                last = float(onset)
        state.update((last, sorted(seen)))
        yield pd.DataFrame({key: k[0], pos: words[pos].astype("int64"), "pool_index": words["pool_index"].astype("int32"), "repetition": repeated, "irt": pd.array(irt, dtype="float64")})

    kind = dict(stream.dtypes)[key]
    return matched.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {pos} long, pool_index int, repetition boolean, irt double", "last double, known array<int>", "append", GroupStateTimeout.NoTimeout)
