"""Ranked lexical search (operator 11): best-first document intervals bounded by range maxima of posting lists.

1. Index. Documents are cut into blocks (``block_docs`` documents, or
   ``block_bytes`` of text) with the documents in the order of their keys, and each
   block keeps the posting lists (document, count) of the terms that the items
   ask for. Blocks are written once to the shared folder.
2. Statistics. Documents, terms and document frequencies are summed over the
   blocks; frequencies of the asked terms go to the driver (at most ``max_terms``
   of them) and come back as weights.
3. Search, one block at a time and all its items together. A posting is worth an
   impact; a sparse table over each list gives the posting of greatest impact in
   any range of documents. The sum of these maxima over an item's terms bounds the
   score of every document of an interval. The intervals with the greatest bounds
   are split at the document with the greatest single impact: that document is
   scored exactly, and both sides get new bounds from two looks into each table.
   An interval whose bound cannot reach the item's k-th score (or only reaches it
   with later keys) is dropped. Instead of one interval a step takes up to
   ``WIDE`` of the best ones of every item, so numpy works on long arrays; that
   changes the order of work, not the result.
4. The best k of every block meet in one window per item; Spark keeps k rows an
   item and task before that shuffle.

Scores are 64-bit integers. Items are read in batches of at most ``max_terms``
terms, each with a pass of its own, so what is broadcast is bounded whatever the
count of items; a text with more terms than that is a batch of its own.

Cases: null and empty texts have no terms: such documents are never found, such
items find nothing; every row is an item or a document of its own, also if it
repeats an id; equal scores by ascending key, null last; texts of any length are
read whole; an empty table of either kind gives no rows; other columns of the
inputs are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, release, small_batches
from .repeats import _order, _read, _write

TOP = 20
WIDE = 32
#: ASCII characters that are no letters or digits part terms; A-Z become a-z, bytes of other characters stay.
_TERM_BYTES = bytes(b if b > 127 or bytes([b]).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


# --- index ------------------------------------------------------------------------------------------------------------


def _blocks(vocabulary, block_docs: int, block_bytes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, lists, docs, size = vocabulary.value, [], [], 0, 0

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            by = np.argsort(_order(rows["k"].combine_chunks()), kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            term, doc, tf = (np.concatenate(x) for x in zip(*lists, strict=True))
            doc = place[doc]
            order = np.argsort(term * len(by) + doc)
            postings = pa.table({"term": pa.array(term[order].astype(np.int32)), "doc": pa.array(doc[order].astype(np.int32)), "tf": pa.array(tf[order].astype(np.int32))})
            lengths = rows["n"].to_numpy()
            sums = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays([*sums, pa.array([_write(rows.take(pa.array(by)))], pa.binary()), pa.array([_write(postings)], pa.binary())], ["docs", "terms", "keys", "postings"])

        for part in parts(batches, 1):
            split = [terms(t) for t in part.column(1).to_pylist()]
            counts = np.array([len(s) for s in split], np.int64)
            ids = np.fromiter(map(number.get, itertools.chain.from_iterable(split), itertools.repeat(-1)), np.int64, int(counts.sum()))
            doc = np.repeat(np.arange(len(split)), counts)[ids >= 0]
            code, tf = np.unique(ids[ids >= 0] * len(split) + doc, return_counts=True)
            lists.append((code // len(split), code % len(split) + docs, tf))
            held.append(pa.RecordBatch.from_arrays([part.column(0), pa.array(counts)], ["k", "n"]))
            docs, size = docs + len(split), size + (pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
            if docs >= block_docs or size >= block_bytes:
                yield close()
                held, lists, docs, size = [], [], 0, 0
        if held:
            yield close()
        release()

    return build


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0):
            term, df = np.unique(_read(body.as_py())["term"].to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df, pa.int64())], ["term", "df"])


# --- search in one block ----------------------------------------------------------------------------------------------


class Lists:
    """Posting lists of a block, one after the other, with a sparse table of the greatest impacts."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.n_docs, self.doc, self.impact = n_docs, doc.astype(np.int64), impact
        self.place = term.astype(np.int64) * n_docs + self.doc  # ascending
        longest = int(np.bincount(term).max(initial=1))
        table = [np.arange(len(term), dtype=np.int32)]
        while 2 << (len(table) - 1) <= longest:
            a, half = table[-1], 1 << (len(table) - 1)
            b = np.concatenate([a[half:], a[len(a) - half :]])[: len(a)]
            table.append(np.where(impact[b] > impact[a], b, a))
        self.table = np.stack(table)

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The posting of greatest impact (the first of equals) among postings ``[lo, hi)`` of one list."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        a, b = self.table[level, lo], self.table[level, hi - (1 << level)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def find(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first posting of each list at or after a document."""
        return np.searchsorted(self.place, term * self.n_docs + doc)


class _Frontier:
    """Open intervals of all items: documents ``[a, b)``, and for each one the postings of the item's terms inside.

    Entries of an interval stand together; ``size`` counts them.
    """

    def __init__(self, lists: Lists, item, a, b, size, term, times, lo, hi):
        self.item, self.a, self.b, self.size = item, a, b, size
        self.term, self.times, self.lo, self.hi = term, times, lo, hi
        if len(item):
            top = lists.greatest(lo, hi)
            worth, heads = times * lists.impact[top], np.cumsum(size) - size
            self.bound = np.add.reduceat(worth, heads)
            most = np.repeat(np.maximum.reduceat(worth, heads), size)
            self.split = np.minimum.reduceat(np.where(worth == most, lists.doc[top], lists.n_docs), heads)
        else:
            self.bound = self.split = np.zeros(0, np.int64)

    _WIDE = ("item", "a", "b", "size", "bound", "split")
    _LONG = ("term", "times", "lo", "hi")

    def take(self, keep: np.ndarray) -> _Frontier:
        out = object.__new__(_Frontier)
        long = np.repeat(keep, self.size)
        for names, mask in ((self._WIDE, keep), (self._LONG, long)):
            for name in names:
                setattr(out, name, getattr(self, name)[mask])
        return out

    def join(self, *others: _Frontier) -> _Frontier:
        out = object.__new__(_Frontier)
        for name in self._WIDE + self._LONG:
            setattr(out, name, np.concatenate([getattr(x, name) for x in (self, *others)]))
        return out


def _place_in_item(item: np.ndarray) -> np.ndarray:
    """Numbers from 0 inside stretches of equal items."""
    at = np.arange(len(item))
    return at - np.maximum.accumulate(np.where(np.concatenate([[True], item[1:] != item[:-1]]), at, 0)) if len(item) else at


def best(lists: Lists, asked: list[dict[int, int]], k: int = TOP, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of the k best documents of every item: greatest score, then smallest place."""
    item = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    term = np.array([t for a in asked for t in a], np.int64)
    times = np.array([n for a in asked for n in a.values()], np.int64)
    lo, hi = lists.find(term, np.zeros(len(term), np.int64)), lists.find(term + 1, np.zeros(len(term), np.int64))
    there = hi > lo
    item, term, times, lo, hi = item[there], term[there], times[there], lo[there], hi[there]
    owners, size = np.unique(item, return_counts=True)
    open_ = _Frontier(lists, owners, np.zeros(len(owners), np.int64), np.full(len(owners), lists.n_docs), size, term, times, lo, hi)
    none = np.zeros(0, np.int64)
    top = (none, none, none)
    floor, last = np.zeros(len(asked), np.int64), np.full(len(asked), -1)  # the k-th score and its document
    while len(open_.item):
        open_ = open_.take((open_.bound > floor[open_.item]) | ((open_.bound == floor[open_.item]) & (open_.a < last[open_.item])))
        by = np.lexsort((open_.a, -open_.bound, open_.item))
        chosen = np.zeros(len(by), bool)
        chosen[by[_place_in_item(open_.item[by]) < wide]] = True
        now, open_ = open_.take(chosen), open_.take(~chosen)
        if not len(now.item):
            break
        owner = np.repeat(np.arange(len(now.item)), now.size)
        x = now.split[owner]
        at = lists.find(now.term, x)
        hit = (at < now.hi) & (lists.doc[np.minimum(at, len(lists.doc) - 1)] == x)
        score = np.add.reduceat(np.where(hit, now.times * lists.impact[np.minimum(at, len(lists.doc) - 1)], 0), np.cumsum(now.size) - now.size)
        top = tuple(np.concatenate(p) for p in zip(top, (now.item, now.split, score), strict=True))
        by = np.lexsort((top[1], -top[2], top[0]))
        by = by[_place_in_item(top[0][by]) < k]
        top = tuple(p[by] for p in top)
        kth = _place_in_item(top[0]) == k - 1
        floor[top[0][kth]], last[top[0][kth]] = top[2][kth], top[1][kth]
        sides = []
        for a, b, lo, hi in ((now.a, now.split, now.lo, at), (now.split + 1, now.b, at + hit, now.hi)):
            full = hi > lo
            size = np.bincount(owner[full], minlength=len(now.item))
            left = size > 0
            sides.append(_Frontier(lists, now.item[left], a[left], b[left], size[left], now.term[full], now.times[full], lo[full], hi[full]))
        open_ = open_.join(*sides)
    return top


def _search(question, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked, ids, n_docs, n_terms = question.value
        weight = np.array(weights, np.int64)
        for batch in batches:
            for keys, body in zip(batch.column(0), batch.column(1), strict=True):
                rows, postings = _read(keys.as_py()), _read(body.as_py())
                term, doc, tf = (postings[c].to_numpy().astype(np.int64) for c in ("term", "doc", "tf"))
                of_use = weight[term] > 0
                term, doc, tf = term[of_use], doc[of_use], tf[of_use]
                if not len(term):
                    continue
                m = 75 + (25 * rows["n"].to_numpy() * n_docs) // n_terms
                lists = Lists(term, doc, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])), rows.num_rows)
                for start in range(0, len(asked), 64):
                    item, found, score = best(lists, asked[start : start + 64], k)
                    good = score > 0
                    row = item[good] + start
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array([ids[i] for i in row.tolist()], pa.int64()), rows["k"].combine_chunks().take(pa.array(found[good])), pa.array(score[good], pa.int64())], ["row", "item", "doc", "score"])
        release()

    return find


# --- search -----------------------------------------------------------------------------------------------------------


def _questions(items: DataFrame, max_terms: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their terms in batches of at most ``max_terms`` terms (one item at least)."""
    held, size = [], 0
    for row in items.toLocalIterator():
        own = Counter(terms(row[1]))
        if held and size + len(own) > max_terms:
            yield held
            held, size = [], 0
        held.append((row[0], own))
        size += len(own) + 1
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_docs: int = 1 << 15, block_bytes: int = 64 << 20, max_terms: int = 200_000) -> DataFrame:
    """(item, rank, key, score): the k documents of greatest score above 0 of every item, ranked from 1."""
    spark = docs.sparkSession
    small_batches(spark)
    found = None
    batches = _questions(items.select(F.col(item).cast("long"), F.col(item_text).cast("string")), max_terms)
    for n, batch in enumerate(batches):
        number = {t: i for i, t in enumerate(sorted({t for _, own in batch for t in own}))}
        vocabulary = spark.sparkContext.broadcast(number)
        index = cut(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(_blocks(vocabulary, block_docs, block_bytes), "docs long, terms long, keys binary, postings binary"), "postings")
        n_docs, n_terms = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        df = index.select("postings").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = [0] * len(number)
        for row in df:
            weights[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
        asked = [{number[t]: c for t, c in own.items()} for _, own in batch]
        question = spark.sparkContext.broadcast((weights, asked, [i for i, _ in batch], n_docs, max(1, n_terms)))
        each = index.select("keys", "postings").mapInArrow(_search(question, k), "row long, item long, doc long, score long").withColumn("batch", F.lit(n))
        found = each if found is None else found.unionByName(each)
    if found is None:
        found = spark.createDataFrame([], "row long, item long, doc long, score long, batch int")
    place = F.row_number().over(Window.partitionBy("batch", "row").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = found.withColumn("place", place).where(F.col("place") <= k)
    return ranked.select(F.col("item").alias(item), F.col("place").alias("rank"), F.col("doc").alias(key), "score")


def plain(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], k: int = TOP) -> list[tuple]:
    """(item, rank, key, score) by scoring every document for every item, for tests."""
    split = [(key, terms(t)) for key, t in docs]
    n_docs, n_terms = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    counts = [(key, len(t), Counter(t)) for key, t in split]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, body in items:
        scores = []
        for key, n, c in counts:
            score = 0
            for t in terms(body):
                if c[t]:
                    m = 75 + (25 * n * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return out
