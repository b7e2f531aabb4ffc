"""Approximate matches of words by an inverted index of letter grams (JON7, SCL4).

The similarity of two words is twice the letters in common blocks over all letters
(Ratcliff-Obershelp). A pair that reaches ratio t obeys, with M the letters in
common blocks, T all letters and ``least = ceil(t * T / 2) <= M``:

* lengths differ by at most the factor ``(2 - t) / t``;
* common letters stand at most ``max(lengths) - least`` places apart, as letters
  outside blocks are all that can push them;
* between two blocks stands a letter outside them, so there are at most
  ``1 + T - 2M`` blocks, and at least ``3 * least - 1 - T`` common pairs of
  neighbours (if that is not positive, at least one common letter).

So items are posted under (gram, place, length), words ask for the grams, places
and lengths that the bounds leave, and pairs with enough hits are compared
exactly. Both sides are shuffled by posting; no side passes through the driver or
is sent to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(a: str, b: str) -> int:
    """Letters in common blocks: the longest block (the first of equals in ``a``, then in ``b``), then those on both sides of it."""
    total, open_ = 0, [(0, len(a), 0, len(b))]
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    while open_:
        a0, a1, b0, b1 = open_.pop()
        size = at_a = at_b = 0
        ends: dict[int, int] = {}
        for i in range(a0, a1):
            here: dict[int, int] = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    here[j] = n = ends.get(j - 1, 0) + 1
                    if n > size:
                        size, at_a, at_b = n, i + 1 - n, j + 1 - n
            ends = here
        if size:
            total += size
            open_ += [(a0, at_a, b0, at_b), (at_a + size, a1, at_b + size, b1)]
    return total


def ratio(a: str, b: str) -> float:
    """SCL4: Ratcliff-Obershelp similarity; the spoken word comes first."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def near_pairs(words: DataFrame, items: DataFrame, threshold: float, norm: str = "norm") -> DataFrame:
    """(norm, item_norm): every pair of a word and an item of ratio ``threshold`` or more, and few others; both sides are distinct words."""
    n, t = F.char_length(norm), float(threshold)
    whole = lambda c: F.sequence(F.lit(0), c - 1)
    posts = items.select(F.col(norm).alias("item_norm"), n.alias("_lb")).where("_lb > 0").withColumn("_at", F.explode(whole(F.col("_lb"))))
    one = F.struct(F.lit(1).alias("q"), F.substring("item_norm", F.col("_at") + 1, F.lit(1)).alias("g"))
    two = F.struct(F.lit(2).alias("q"), F.substring("item_norm", F.col("_at") + 1, F.lit(2)).alias("g"))
    posts = posts.withColumn("_g", F.explode(F.array(one, two))).where("char_length(_g.g) = _g.q").select("item_norm", F.col("_g.g").alias("_gram"), "_at", "_lb")
    low, high = F.greatest(F.ceil(n * (t / (2 - t)) - 1e-9), F.lit(1)).cast("int"), F.floor(n * ((2 - t) / t) + 1e-9).cast("int")
    asks = words.select(norm, n.alias("_la")).where("_la > 0").select(norm, "_la", F.explode(F.sequence(low, high)).alias("_lb"))
    asks = asks.withColumn("_least", F.ceil((F.col("_la") + F.col("_lb")) * (t / 2) - 1e-9).cast("int"))
    asks = asks.withColumn("_common", 3 * F.col("_least") - 1 - F.col("_la") - F.col("_lb")).withColumn("_q", F.when(F.col("_common") >= 1, 2).otherwise(1))
    asks = asks.withColumn("_shift", F.greatest("_la", "_lb") - F.col("_least")).where("_la >= _q and _lb >= _q").withColumn("_i", F.explode(whole(F.col("_la") - F.col("_q") + 1)))
    near = F.sequence(F.greatest(F.col("_i") - F.col("_shift"), F.lit(0)), F.least(F.col("_i") + F.col("_shift"), F.col("_lb") - F.col("_q")))
    asks = asks.where(F.greatest(F.col("_i") - F.col("_shift"), F.lit(0)) <= F.least(F.col("_i") + F.col("_shift"), F.col("_lb") - F.col("_q")))
    asks = asks.select(norm, "_lb", "_common", F.substring(norm, F.col("_i") + 1, F.col("_q")).alias("_gram"), F.explode(near).alias("_at"))
    hits = asks.join(posts, ["_gram", "_at", "_lb"]).groupBy(norm, "item_norm").agg(F.count("*").alias("_hits"), F.max("_common").alias("_common"))
    return hits.where("_hits >= _common").select(norm, "item_norm")


def best_near(words: DataFrame, items: DataFrame, threshold: float, norm: str = "norm") -> DataFrame:
    """(norm, score, pool_index): the best item of every distinct word that reaches ``threshold``; ties to the first index.

    ``items``: (norm, pool_index). Words without such an item are left out.
    """
    first = items.where(F.col(norm).isNotNull()).groupBy(norm).agg(F.min("pool_index").alias("pool_index"))
    pairs = near_pairs(words.select(norm).where(F.col(norm).isNotNull()).distinct(), first, threshold, norm)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([ratio(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            keep = pa.array(score >= threshold, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(score).filter(keep)], names=[norm, "item_norm", "score"])

    scored = pairs.mapInArrow(compare, f"`{norm}` string, item_norm string, score double").join(first.withColumnRenamed(norm, "item_norm"), "item_norm")
    top = scored.groupBy(norm).agg(F.max(F.struct("score", (-F.col("pool_index")).alias("i"))).alias("_b"))
    return top.select(norm, F.col("_b.score").alias("score"), (-F.col("_b.i")).alias("pool_index"))
