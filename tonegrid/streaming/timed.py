"""Ordered functions on streams whose rows come in any order (STR3, STR4, STR5): timers release rows as the watermark passes.

A row is held in its key's state until the watermark has passed its time; then a
timer (one a key, for its earliest row) hands all rows up to the watermark on, in order, to a step function with the
key's memory (the last offset, the items recalled so far). So results do not
depend on the order or the triggers in which rows arrive; rows that come after the
watermark has passed their time are dropped, as in other windows. A key that is
silent for ``keep_seconds`` of event time forgets its memory, by another timer, so
state ends with its stimulus.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.scalars import normalise_word

#: Timers stand on whole multiples of this.
GRAIN_MS = 1000

Step = Callable[[tuple | None, list[tuple]], tuple[tuple, list[tuple]]]


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; a session that has chosen a store keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Release(StatefulProcessor):
    """Rows (milliseconds, values…) of a key in order, and the memory between them."""

    def __init__(self, names: list[str], memory: str, out: list[str], step: Step, keep_ms: int):
        self.names, self.memory_schema, self.out, self.step, self.keep_ms = names, memory, out, step, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows string")  # one entry a trigger: every call to the store is a round trip
        self.memory = handle.getValueState("memory", f"ms long, {self.memory_schema}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for part in rows:
            values = zip(*[part[n].tolist() for n in ("event_ms", *self.names)], strict=True)
            fresh += [v for v in values if v[0] > passed]
        if fresh:
            self.held.appendValue((json.dumps(fresh),))
            self._arm(fresh)
        return iter(())

    def _arm(self, rows: list[tuple]) -> None:
        """One timer, for the earliest of the rows: it releases all that the watermark has passed by then."""
        self.handle.registerTimer(-(-min(r[0] for r in rows) // GRAIN_MS) * GRAIN_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for part in self.held.get() for r in json.loads(part[0])] if self.held.exists() else []
        due, rest = sorted(r for r in held if r[0] <= now), [r for r in held if r[0] > now]
        known = tuple(self.memory.get()) if self.memory.exists() else None
        if due:
            if rest:
                self.held.put([(json.dumps(rest),)])
                self._arm(rest)
            else:
                self.held.clear()
            after, found = self.step(known[1:] if known else None, [r[1:] for r in due])
            self.memory.update((due[-1][0], *after))
            self.handle.registerTimer(-(-(due[-1][0] + self.keep_ms) // GRAIN_MS) * GRAIN_MS)
            if found:
                yield pd.DataFrame(dict(zip(self.out, zip(*found, strict=True), strict=True))).assign(key_=key[0])
        elif known and known[0] + self.keep_ms <= now:
            self.memory.clear()

    def close(self) -> None:
        pass


def _released(stream: DataFrame, key: str, ts: str, late: str, names: list[str], memory: str, out: str, step: Step, keep_seconds: float) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    kinds = dict(stream.dtypes)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("event_ms", F.unix_millis(ts)).withWatermark(ts, late)
    schema = StructType.fromDDL(f"{out}, key_ {kinds[key]}")
    processor = Release(names, memory, [f.name for f in schema.fields[:-1]], step, int(keep_seconds * 1000))
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime").withColumnRenamed("key_", key)


def timed_pauses(stream: DataFrame, min_pause: float = 0.5, ts: str = "ts", late: str = "10 minutes", keep_seconds: float = 86_400.0, key: str = "stimulus_id") -> DataFrame:
    """WIN3 on a stream of words (key, ts, onset, offset) in any order: (key, onset, pause), as the batch operator has them."""

    def step(known: tuple | None, words: list[tuple]) -> tuple[tuple, list[tuple]]:
        last, found = known[0] if known else None, []
        for onset, offset in words:
            if last is not None and onset - last >= min_pause:
                found.append((onset, onset - last))
            last = offset
        return (last,), found

    return _released(stream, key, ts, late, ["onset", "offset"], "last double", "onset double, pause double", step, keep_seconds).select(key, "onset", "pause")


def timed_recall(stream: DataFrame, pool: DataFrame, ts: str = "ts", late: str = "10 minutes", keep_seconds: float = 86_400.0, key: str = "stimulus_id", pos: str = "pos") -> DataFrame:
    """STR4: WIN1-2 on a stream of spoken words (key, ts, pos, word, onset) in any order: pool index, repetition, inter-response time."""
    first = pool.select("pool_index", normalise_word(F.col("item")).alias("norm")).groupBy("norm").agg(F.min("pool_index").alias("pool_index"))
    matched = stream.select(key, ts, F.col(pos).cast("long").alias(pos), F.col("onset").cast("double").alias("onset"), normalise_word(F.col("word")).alias("norm"))
    matched = matched.join(first, "norm", "left").select(key, ts, pos, "onset", F.coalesce("pool_index", F.lit(-1)).cast("int").alias("pool_index"))

    def step(known: tuple | None, words: list[tuple]) -> tuple[tuple, list[tuple]]:
        last, seen = (known[0], {*known[1]}) if known else (None, set())
        found = []
        for place, onset, index in words:
            hit = index >= 0
            found.append((place, index, bool(hit and index in seen), round(onset - last, 3) if hit and last is not None else None))
            if hit:
                seen.add(index)
                last = onset
        return (last, sorted(seen)), found

    out = f"{pos} long, pool_index int, repetition boolean, irt double"
    return _released(matched, key, ts, late, [pos, "onset", "pool_index"], "last double, known array<int>", out, step, keep_seconds).select(key, pos, "pool_index", "repetition", "irt")
