"""Periodic runs of words (operator 13) by internal pattern matching.

A run is a stretch of words of a document with smallest period q and a length of
at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` that neither neighbour extends. All
runs of a document are found; ``collapsed`` is its text with every run cut down to
its first period.

How a period is found. Let ``m = 2**k <= q < 2m``. As a run has four periods, it
holds a block ``[p, p + m)`` that starts at a multiple of m, and the same words
again at ``p + q``. So the occurrences of every dyadic block are asked for in the
window of starts ``[p + m, p + 2m)`` beside it:

* The suffix array of the words comes from prefix doubling; the order after round
  k gives each block of ``2**k`` words its interval of suffixes.
* A wavelet matrix over the suffix array answers range successor queries: the
  least text position of at least x in an interval.
* One or two occurrences are candidate periods themselves. Three or more form a
  progression whose difference d is the period of the block. The stretch of
  period d around the block is shorter than q + d inside the run (else q would
  not be the smallest period), so one of its ends lies in the run, and the stretch
  around the second occurrence has the same end q further on. The distances of the
  left ends and of the right ends are the two candidates.
* A candidate is extended to both sides by the classes of prefix doubling (binary
  steps). Of candidates with the same ends the least is the smallest period.

So a block costs at most three queries, whatever the text. Periods under
``SHORT`` need no search: the words are compared with those 1 to 7 places on. A
document in which no aligned block of ``SHORT`` words occurs a second time has no
longer period and is done after one sort of block hashes.

Everything is a narrow pass over whole documents in slices of 4 MB of text (a
longer one alone), vectorised over the documents of a slice; memory is about 300
bytes a word of the documents that repeat themselves.

Cases: null and empty texts have no words and no runs; texts of any length are
searched whole; repeated rows have equal results; null keys stay; an empty table
gives no rows; other columns of the input are not looked at, and the result has
the key and its own columns only.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, parts, small_batches

MIN_LENGTH = 6
MIN_EXPONENT = 4
SHORT_LEVEL = 3
SHORT = 1 << SHORT_LEVEL

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _least(period):
    return np.maximum(MIN_LENGTH, MIN_EXPONENT * period)


class Wavelet:
    """A wavelet matrix over numbers below ``2**bits``: range successor queries, many at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros = []  # of each level, how many zero bits stand before each place
        values = values.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            upto = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=upto[1:])
            self.zeros.append(upto)
            values = np.concatenate([values[~one], values[one]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers at places ``[left, right)`` are less than x."""
        found = np.zeros(len(x), np.int64)
        for level, upto in enumerate(self.zeros):
            a, b = upto[left].astype(np.int64), upto[right].astype(np.int64)
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            found += np.where(one, b - a, 0)
            left, right = np.where(one, upto[-1] + left - a, a), np.where(one, upto[-1] + right - b, b)
        return found

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number that k others at places ``[left, right)`` precede in order."""
        found = np.zeros(len(k), np.int64)
        for level, upto in enumerate(self.zeros):
            a, b = upto[left].astype(np.int64), upto[right].astype(np.int64)
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            found |= np.where(one, 1 << (self.bits - 1 - level), 0)
            left, right = np.where(one, upto[-1] + left - a, a), np.where(one, upto[-1] + right - b, b)
        return found

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The least number of at least x at places ``[left, right)``; ``none`` where there is none."""
        out, ask = np.full(len(x), none, np.int64), np.flatnonzero(x < 1 << self.bits)
        k = self.below(left[ask], right[ask], x[ask])
        there = k < right[ask] - left[ask]
        ask, k = ask[there], k[there]
        out[ask] = self.smallest(left[ask], right[ask], k)
        return out


class Suffixes:
    """Prefix doubling over several documents in a row: classes of all stretches of ``2**k`` words, and the suffix array.

    The class of a stretch is the place in the suffix array where its suffixes
    begin, so classes of later rounds refine earlier ones. Words of different
    documents are different; a stretch that a document's end cuts is equal to none.
    """

    def __init__(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray):
        n = len(words)
        self.begin, self.end = begin, end
        place = np.arange(n, dtype=np.int64)
        self.array = np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        rank, open_, key, step = np.zeros(n, np.int64), place, words.astype(np.int64), 0
        while True:
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            old, at = rank[open_], np.arange(len(open_), dtype=np.int64)
            head = np.concatenate([[True], old[1:] != old[:-1]])
            index = old + at - np.maximum.accumulate(np.where(head, at, 0))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, at, 0))
            rank[open_] = index[first]
            self.array[index] = open_
            self.levels.append(rank.astype(np.int32))
            alone = new & np.concatenate([new[1:], [True]])
            open_ = open_[~alone]
            if not len(open_):
                break
            step = step * 2 or 1
            ahead = open_ + step
            inside = ahead < end[open_]
            key = rank[open_] * (n + 1) + np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal (i < j, one document)."""
        end, n, start = self.end[i], len(self.end), i
        for k in range(len(self.levels) - 1, -1, -1):
            same = (j + (1 << k) <= end) & (self.levels[k][np.minimum(i, n - 1)] == self.levels[k][np.minimum(j, n - 1)])
            i, j = i + (same << k), j + (same << k)
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal (i < j, one document)."""
        begin, start = self.begin[i], i
        for k in range(len(self.levels) - 1, -1, -1):
            there = i - (1 << k) >= begin
            same = there & (self.levels[k][np.maximum(i - (1 << k), 0)] == self.levels[k][np.maximum(j - (1 << k), 0)])
            i, j = i - (same << k), j - (same << k)
        return start - i

    def extent(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of the longest stretch of period q around p (``p + q`` lies in the document)."""
        return p - self.backward(p, p + q), p + self.forward(p, p + q) + q


def long_runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Runs:
    """Candidate runs of periods of ``SHORT`` or more: start, end, period."""
    suffixes = Suffixes(words, begin, end)
    wavelet, n = Wavelet(suffixes.array), len(words)
    place = np.arange(n, dtype=np.int64)
    found = []
    for k in range(SHORT_LEVEL, len(suffixes.levels)):
        m = 1 << k
        p = place[((place - begin) % m == 0) & (place + 2 * m <= end)]
        size = np.bincount(suffixes.levels[k], minlength=n)
        left = suffixes.levels[k][p].astype(np.int64)
        twice = size[left] > 1
        p, left = p[twice], left[twice]
        right = left + size[left]
        first = wavelet.successor(left, right, p + m, n)
        near = first < p + 2 * m
        p, left, right, first = p[near], left[near], right[near], first[near]
        second = wavelet.successor(left, right, first + 1, n)
        two = second < p + 2 * m
        third = np.full(len(p), n, np.int64)
        third[two] = wavelet.successor(left[two], right[two], second[two] + 1, n)
        many = third < p + 2 * m
        few, pair = ~many, two & ~many
        found += [(p[few], first[few] - p[few]), (p[pair], second[pair] - p[pair])]
        own, other = p[many], first[many]
        step = second[many] - other
        (a, b), (c, d) = suffixes.extent(own, step), suffixes.extent(other, step)
        for q in (c - a, d - b):
            fits = (q >= m) & (q < 2 * m)
            found.append((own[fits], q[fits]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = suffixes.extent(p, q)
    keep = b - a >= _least(q)
    return a[keep], b[keep], q[keep]


def short_runs(words: np.ndarray, end: np.ndarray) -> Runs:
    """Candidate runs of periods under ``SHORT``: start, end, period."""
    found = []
    for q in range(1, SHORT):
        same = (words[:-q] == words[q:]) & (end[:-q] == end[q:])
        edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
        a, b = edge[::2], edge[1::2] + q
        keep = b - a >= _least(q)
        found.append((a[keep], b[keep], np.full(int(keep.sum()), q, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _repeating(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words lie in documents where an aligned block of ``SHORT`` words occurs a second time (or its hash does)."""
    n = len(words) - SHORT + 1
    if n < 2:
        return np.zeros(len(words), bool)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = end[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(SHORT):
        total += mixed[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64))
    whole = np.arange(n) + SHORT <= end[:n]
    s = np.sort(total[whole])
    again = np.unique(s[1:][s[1:] == s[:-1]])
    block = np.flatnonzero(whole & ((np.arange(n) - begin[:n]) % SHORT == 0))
    if not len(again):
        return np.zeros(len(words), bool)
    hit = block[again[np.minimum(np.searchsorted(again, total[block]), len(again) - 1)] == total[block]]
    mark = np.zeros(len(words) + 1, np.int64)
    docs = np.unique(begin[hit], return_index=True)
    mark[docs[0]] = 1
    mark[end[hit[docs[1]]]] -= 1
    return np.cumsum(mark[:-1]) > 0


def runs_of(words: np.ndarray, counts: np.ndarray) -> Runs:
    """All runs of documents that stand in a row (``counts`` words each): start, end, period, by start and period."""
    ends = np.cumsum(counts)
    begin, end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
    found = [short_runs(words, end)]
    own = np.flatnonzero(_repeating(words, begin, end))
    if len(own):
        # documents that repeat themselves move together; words get numbers of their document
        _, doc_begin = np.unique(begin[own], return_inverse=True)
        sizes = np.bincount(doc_begin)
        upto = np.cumsum(sizes)
        shift = own - np.arange(len(own))
        a, b, q = long_runs(doc_begin * (int(words.max()) + 1) + words[own], (upto - sizes)[doc_begin], upto[doc_begin])
        found.append((a + shift[a], b + shift[a], q))
    a, b, q = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((q, b, a))
    a, b, q = a[by], b[by], q[by]
    one = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    a, b, q = a[one], b[one], q[one]
    by = np.lexsort((q, a))
    return a[by], b[by], q[by]


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed): runs as (start, length, period) by start and period; words are numbered from 0."""
    small_batches(df.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch.column(1).to_pylist()]
            counts = np.array([len(w) for w in split], np.int64)
            number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
            words = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
            a, b, q = runs_of(words, counts)
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, a, side="right")
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, a + q, 1)
            np.add.at(edge, b, -1)
            stays = np.cumsum(edge[:-1]) == 0
            texts, begin = [], 0
            for own, finish in zip(split, ends.tolist(), strict=True):
                left = stays[begin:finish]
                texts.append(b" ".join(own if left.all() else [own[i] for i in np.flatnonzero(left)]))
                begin = finish
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))]).astype(np.int32)
            cells = [pa.array(x, pa.int64()) for x in (a - (ends - counts)[doc], b - a, q)]
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cells, fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], [key, "n_words", "runs", "collapsed"])

    narrow = df.select(key, F.col(text).cast("string").alias("_text"))
    schema = f"`{key}` {narrow.schema[0].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return narrow.mapInArrow(search, schema)


def planted(text: Column, key: Column) -> Column:
    """``text`` with a periodic tail in every tenth document: the rule of the query, by crc32 of the key."""
    hashed = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(hashed / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        start = g % n
        period = F.lit(1) + F.floor((n - start) / (F.lit(3) + g % 8))
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i >= start, F.get(words, (start + (i - start) % period).cast("int"))).otherwise(w)), " "))

    split = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    once = F.transform(F.array(split), tail)[0]  # bound to a variable, the words are split once a text and not once a word
    return F.when(hashed % 10 == 0, F.coalesce(once, text)).otherwise(text)


def plain(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs of one document by comparing it with itself at every distance, for tests."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // MIN_EXPONENT + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(MIN_LENGTH, MIN_EXPONENT * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())
