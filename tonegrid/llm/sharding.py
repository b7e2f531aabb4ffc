"""Reproducible shuffling into shards (operator 6).

Every row has a global number 0 … N-1 that depends on the rows alone, not on
files or partitions: rows are ordered by (hash bucket, key, size, checksum). A
keyed Feistel permutation of [0, N) moves number r to place π(r); the shard is
π(r) mod S and the slot π(r) div S. Both, and the inverse, are computable from
(N, seed, S) alone. Law: ``rows`` (shard counts differ by one at most).

Row numbers take no single-partition sort: equal rows are counted first (so a
third of all rows being one row is one group), groups fall into hash buckets of
about ``BUCKET_GROUPS`` groups, and a running sum inside a bucket gives each
group its range of numbers. Buckets are totalled in runs of ``RUN``: a window
inside a run and the totals of the runs (one row for 67 million groups) give the
offsets, so neither a task nor the driver gets more as rows grow.

The permutation is a Feistel network over Z_a × Z_b with a·b ≥ N, a ≈ √N, whose
few surplus points are walked until they fall inside [0, N) (cycle walking).

Cases: null and empty texts have size 16 and checksum 0; null keys are a value
like any other; very long texts are read once, for size and checksum; repeated
rows each get a slot; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_field

ROUNDS = 8
#: Groups of equal rows aimed at in a bucket, and buckets in a run.
BUCKET_GROUPS = 1 << 14
RUN = 1 << 12
SEED = 20240607


def _mix(values: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (fixed values: the public SplitMix64 constants)."""
    z = values.astype(np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Feistel:
    """A keyed permutation of [0, n)."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=np.uint64), seed * 0x9E3779B97F4A7C15)]

    def _walk(self, points: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(points, dtype=np.int64))
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= self.n]
        return out

    def _forward(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for k, key in enumerate(self.keys):
            if k % 2:
                right = (right + (_mix(left, key) % np.uint64(self.b)).astype(np.int64)) % self.b
            else:
                left = (left + (_mix(right, key) % np.uint64(self.a)).astype(np.int64)) % self.a
        return left * self.b + right

    def _backward(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for k, key in reversed(list(enumerate(self.keys))):
            if k % 2:
                right = (right - (_mix(left, key) % np.uint64(self.b)).astype(np.int64)) % self.b
            else:
                left = (left - (_mix(right, key) % np.uint64(self.a)).astype(np.int64)) % self.a
        return left * self.b + right

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self._forward)

    def row(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self._backward)


def row_at(shard: int, slot: int, n_rows: int, n_shards: int, seed: int = SEED) -> int:
    """Global row number that sits in a slot of a shard."""
    place = slot * n_shards + shard
    if not (0 <= shard < n_shards and 0 <= slot and place < n_rows):
        raise ValueError("no such slot")
    return int(Feistel(n_rows, seed).row(np.array([place]))[0])


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` (0 … N-1, a function of the rows only), and N."""
    names = rows.columns
    groups = cut(rows.groupBy(*names).agg(F.count("*").alias("_m")), "shard-groups")
    buckets = max(1, groups.count() // BUCKET_GROUPS)
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    totals = groups.groupBy("_bucket").agg(F.sum("_m").alias("_n")).withColumn("_run", F.expr(f"_bucket div {RUN}"))
    runs = sorted((r._run, r._n) for r in totals.groupBy("_run").agg(F.sum("_n").alias("_n")).collect())
    n_rows = sum(n for _, n in runs)
    starts, at = [], 0
    for run, n in runs:
        starts.append((run, at))
        at += n
    firsts = rows.sparkSession.createDataFrame(starts, "_run long, _first long")
    before = Window.partitionBy("_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.withColumn("_upto", F.sum("_n").over(before)).join(firsts, "_run").select("_bucket", (F.col("_first") + F.col("_upto") - F.col("_n")).alias("_start"))
    order = Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = groups.withColumn("_last", F.sum("_m").over(order)).join(offsets, "_bucket")
    first = F.col("_start") + F.col("_last") - F.col("_m")
    spread = numbered.select(*names, first.alias("_first"), F.explode(F.sequence(F.lit(0), F.expr("int((_m - 1) div 65536)"))).alias("_part"), "_m")
    low = F.col("_part").cast("long") * 65536
    high = F.least(low + 65535, F.col("_m") - 1)
    return spread.select(*names, F.explode(F.sequence(F.col("_first") + low, F.col("_first") + high)).alias("row_number")), n_rows


def assign_shards(docs: DataFrame, n_shards: int = 40, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard) of every row."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    facts = docs.select(docs[key].alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    numbered, n_rows = number_rows(facts)
    names = ["doc_id", "size", "text_crc32", "row_number", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Feistel(n_rows, seed)
        for batch in batches:
            places = permutation.place(batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=names)

    placed = numbered.mapInArrow(run, with_field(numbered, "place", "long"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
