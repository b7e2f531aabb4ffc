"""Free recall against a word pool (JON6-7, WIN1-2, AGG4-5, TXT5), set-based."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import half_even, normalise_word
from .fuzzy import best_near, ratio
from .grid import KEY
from .scan import LastBefore, scan

FUZZY_THRESHOLD = 0.8
#: Items of a pool that are sent to every executor at once; larger pools go in blocks.
MAX_POOL = 10_000


@F.pandas_udf(DoubleType())
def fuzzy_ratio(spoken: pd.Series, item: pd.Series) -> pd.Series:
    """SCL4: Ratcliff-Obershelp similarity; the spoken word is the first sequence."""
    return pd.Series([ratio(a, b) for a, b in zip(spoken, item, strict=True)], dtype="float64")


def pool_table(items: DataFrame, item: str = "item", index: str = "pool_index") -> DataFrame:
    return items.select(F.col(index).cast("int").alias("pool_index"), F.col(item).alias("item"), normalise_word(F.col(item)).alias("norm"))


class BestItem:
    """The best item of a pool for every spoken word, by the ratio of ``fuzzy_ratio``; ties to the first index.

    Matched letters are at most the letters in common, so a matrix product over
    (letter, occurrence) bounds all ratios at once, and items are compared in
    order of their bounds until no bound can beat the best ratio: exact, with
    few comparisons a word.
    """

    def __init__(self, items: list[tuple[str, int]]):
        items = sorted(items, key=lambda x: x[1])
        self.indices = [i for _, i in items]
        self.sizes = np.array([len(n) for n, _ in items])
        self.names = [n for n, _ in items]
        self.places: dict[tuple[str, int], int] = {}
        marks = [[self.places.setdefault(x, len(self.places)) for x in self._letters(n)] for n, _ in items]
        self.table = np.zeros((len(self.places), len(items)), dtype=np.float32)
        for k, mine in enumerate(marks):
            self.table[mine, k] = 1

    @staticmethod
    def _letters(word: str) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        out = []
        for c in word:
            seen[c] = seen.get(c, 0) + 1
            out.append((c, seen[c]))
        return out

    def find(self, words: list[str]) -> list[tuple[float, int]]:
        """(score, pool index) of every word."""
        marks = np.zeros((len(words), len(self.places)), dtype=np.float32)
        for k, word in enumerate(words):
            marks[k, [self.places[x] for x in self._letters(word) if x in self.places]] = 1
        total = np.array([len(w) for w in words])[:, None] + self.sizes
        bounds = np.where(total > 0, 2.0 * (marks @ self.table) / np.maximum(total, 1), 1.0)
        return [self._best(word, row) for word, row in zip(words, bounds, strict=True)]

    def _best(self, word: str, bounds: np.ndarray) -> tuple[float, int]:
        best, at = -1.0, -1
        near = np.flatnonzero(bounds >= np.partition(bounds, -min(64, len(bounds)))[-min(64, len(bounds))])
        for part in (near, None):
            if part is None:  # more than the nearest are needed only where bounds reach the best ratio
                part = np.setdiff1d(np.flatnonzero(bounds >= best), near, assume_unique=True)
            for k in part[np.argsort(-bounds[part], kind="stable")].tolist():
                if bounds[k] < best:
                    break
                if bounds[k] == best and k > at:
                    continue
                score = ratio(word, self.names[k])
                if score > best or score == best and k < at:
                    best, at = score, k
        return best, self.indices[at]


def best_any(words: DataFrame, pool: DataFrame, norm: str = "norm") -> DataFrame:
    """(norm, score, pool_index): the best pool item of every distinct word, however far; ties to the first index.

    The pool is stated queries in blocks of at most ``MAX_POOL`` items: the best of
    every block, then the best of the blocks.
    """
    blocks = max(1, -(-pool.count() // MAX_POOL))
    distinct = words.select(norm).where(F.col(norm).isNotNull()).distinct()
    best = None
    for block in range(blocks):
        items = [tuple(r) for r in pool.where(F.pmod(F.col("pool_index"), F.lit(blocks)) == block).select("norm", "pool_index").collect()]

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            search = BestItem(items)
            for batch in batches:
                for start in range(0, batch.num_rows if items else 0, 512):
                    part = batch.column(0).slice(start, 512)
                    scores, indices = zip(*search.find(part.to_pylist()), strict=True)
                    yield pa.RecordBatch.from_arrays([part, pa.array(scores, pa.float64()), pa.array(indices, pa.int32())], names=[norm, "score", "pool_index"])

        mine = distinct.mapInArrow(run, f"`{norm}` string, score double, pool_index int")
        best = mine if best is None else best.unionAll(mine)
    if blocks == 1:
        return best
    top = best.groupBy(norm).agg(F.max(F.struct("score", (-F.col("pool_index")).alias("i"))).alias("_b"))
    return top.select(norm, F.col("_b.score").alias("score"), (-F.col("_b.i")).alias("pool_index"))


def best_fuzzy(words: DataFrame, pool: DataFrame, norm: str = "norm", threshold: float = FUZZY_THRESHOLD, below: bool = True) -> DataFrame:
    """JON7: (norm, score, pool_index, item) of every distinct word's best item; ties to the first index.

    Where only items at or over ``threshold`` matter (``below`` false), they come
    from the index of grams (``fuzzy``), and no word meets the whole pool. The best
    of what is farther away has no such bound: then words and pool meet in blocks.
    """
    best = best_any(words, pool, norm) if below else best_near(words, pool, threshold, norm)
    return best.join(pool.select("pool_index", "item"), "pool_index").select(norm, "score", "pool_index", "item")


def annotate_recall(words: DataFrame, pool: DataFrame, threshold: float = FUZZY_THRESHOLD, pos: str = "pos", fuzzy: bool = True, key: str = KEY, width: float | None = None, below: bool = True) -> DataFrame:
    """TXT5: matched item, score, intrusion, repetition and inter-response time of every word.

    ``words`` has key, ``pos`` (order of speech), word, onset, offset and
    possibly is_filler; fillers are left out. Exact matches are an equi-join;
    the fuzzy search sees distinct unmatched words only. Without ``below``, words
    that match nothing have a score of 0 instead of that of their best item.
    ``width``: response times by a scan over buckets of so many places (two reads
    of the words, for stimuli too long for one task); None: a window a stimulus.
    """
    spoken = words.where(~F.coalesce(F.col("is_filler"), F.lit(False))) if "is_filler" in words.columns else words
    spoken = spoken.withColumn("norm", normalise_word(F.col("word")))
    table = pool_table(pool)
    first = table.groupBy("norm").agg(F.min(F.struct("pool_index", "item")).alias("_p")).select("norm", F.col("_p.pool_index").alias("_exact"), F.col("_p.item").alias("_exact_item"))
    exact = spoken.join(first, "norm", "left")
    if fuzzy:
        near = best_fuzzy(exact.where("_exact is null"), table, "norm", threshold, below).select("norm", F.col("score").alias("_score"), F.col("pool_index").alias("_near"), F.col("item").alias("_near_item"))
        exact = exact.join(near, "norm", "left")
    else:
        exact = exact.withColumn("_score", F.lit(None).cast("double")).withColumn("_near", F.lit(None).cast("int")).withColumn("_near_item", F.lit(None).cast("string"))
    score = F.when(F.col("_exact").isNotNull(), 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    marked = exact.withColumn("_s", score).withColumn("_matched", F.col("_s") >= threshold)
    marked = marked.withColumn("_index", F.when(F.col("_matched"), F.coalesce("_exact", "_near")))
    by_item = Window.partitionBy(key, "_index").orderBy(pos)
    marked = marked.withColumn("_again", F.row_number().over(by_item) > 1)
    marked = marked.withColumn("_at", F.when(F.col("_matched"), F.col("onset")))
    if width is None:
        before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        marked = marked.withColumn("_last", F.last("_at", ignorenulls=True).over(before))
    else:
        marked = scan(marked, key, [pos], width, _last=LastBefore("_at"))
    return marked.select(
        key,
        pos,
        "word",
        "onset",
        "offset",
        F.when(F.col("_matched"), F.coalesce("_exact_item", "_near_item")).otherwise("").alias("matched_item"),
        F.coalesce("_index", F.lit(-1)).alias("pool_index"),
        half_even("_s", 3).alias("match_score"),
        (~F.col("_matched")).alias("intrusion"),
        (F.col("_matched") & F.col("_again")).alias("repetition"),
        F.when(F.col("_matched"), half_even(F.col("onset") - F.col("_last"), 3)).alias("irt"),
    )


def recall_summary(recall: DataFrame, pool_size: int, threshold: float = FUZZY_THRESHOLD, key: str = KEY) -> DataFrame:
    """AGG4-5: counts, proportion recalled and response times, in one aggregation."""
    fresh = ~F.col("intrusion") & ~F.col("repetition")
    return recall.groupBy(key).agg(
        F.lit(pool_size).alias("pool_size"),
        F.countDistinct(F.when(fresh, F.col("pool_index"))).alias("n_recalled"),
        half_even(F.countDistinct(F.when(fresh, F.col("pool_index"))) / F.lit(pool_size), 4).alias("proportion_recalled"),
        F.count_if(F.col("intrusion")).alias("n_intrusions"),
        F.count_if(F.col("repetition")).alias("n_repetitions"),
        F.lit(threshold).alias("fuzzy_threshold"),
        half_even(F.median("irt"), 3).alias("median_irt"),
    )
