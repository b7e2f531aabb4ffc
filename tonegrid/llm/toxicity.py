"""Toxicity from subword bags (operator 3).

A text is the mean of the embeddings of its subwords (every word as a whole and
its character 3- to 5-grams with word marks); a linear softmax reads that mean.
Embeddings and softmax are trained jointly in numpy, over a bounded sample of
labelled rows: at most ``max_positive`` toxic and ``max_negative`` other
documents, the first by a hash of their id. The tasks that read a sampled text
turn it into a bag of words; one task trains on these bags, and only the model
comes to the driver. An unseen misspelling shares most character n-grams with
the word it hides.

Scoring is one pass without a shuffle. The model (``buckets`` floats, 1 MB at
the default) is the only thing sent to executors and does not grow with the
data. Words are scored once per worker and batch of new words, in numpy.

Cases: null and empty texts have no subwords and get the score of the bias
alone; very long texts are scored whole; an empty table gives no rows; repeated rows are scored row by row; with no
usable labels of either class every score is 0; other columns are kept, but for
one named like the score, which is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, release, small_batches, texts, with_field

_WORD = re.compile(r"\w+")
_MEMO_WORDS = 250_000
_PART = 20_000
_CHUNK = 1 << 20


@dataclass(frozen=True)
class ToxicityParams:
    """Bounds of the sample, and of the training."""

    max_positive: int = 1500
    max_negative: int = 3000
    buckets: int = 1 << 18
    dims: int = 4
    min_docs: int = 30  # subwords in fewer sampled documents carry no weight
    steps: int = 40
    rate: float = 0.05
    decay: float = 1e-5
    prior: float = 0.2  # share of the loss given to label 1
    scale: float = 20.0
    seed: int = 0


@dataclass(frozen=True)
class ToxicityModel:
    """``weights[bucket]``: logit of a subword; a text's logit is their mean plus ``bias``."""

    weights: np.ndarray
    bias: float
    fitted: bool


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every subword of every word, without a loop over n-grams."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, found = [np.arange(len(words))], [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], dtype=np.int64)]
    rolling = codes
    for n in range(2, 6):
        if len(codes) < n:
            break
        rolling = rolling[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
        if n < 3:
            continue
        inside = owner[: len(rolling)] == owner[n - 1 :]
        mixed = rolling[inside]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(40)).astype(np.int64) % buckets)
        owners.append(owner[: len(rolling)][inside])
    return np.concatenate(owners), np.concatenate(found)


def _in_parts(words: list[str], buckets: int):
    for start in range(0, len(words), _PART):
        yield start, *subwords(words[start : start + _PART], buckets)


def bag(text: str) -> tuple[list[str], list[int]]:
    """The distinct words of ``text`` in order of appearance, and how often each occurs."""
    found = Counter(_WORD.findall(text.lower()))
    return list(found), list(found.values())


def fit(sample: list[str], labels: list[int], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """``fit_bags`` of texts."""
    return fit_bags(map(bag, sample), labels, params)


def fit_bags(bags: Iterable[tuple[list[str], list[int]]], labels: list[int], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Joint training of embeddings and softmax by Adam over the whole sample."""
    p = params
    y = np.asarray(labels, dtype=np.int64)
    n = len(y)
    if not n or y.min() == y.max():
        return ToxicityModel(np.zeros(p.buckets), -745.0, False)
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    rows, cols, counts = [], [], []
    for k, (found, times) in enumerate(bags):
        distinct = np.fromiter(map(ids.__getitem__, found), dtype=np.int32, count=len(found))
        order = np.argsort(distinct)
        rows.append(np.full(len(distinct), k, dtype=np.int32))
        cols.append(distinct[order])
        counts.append(np.array(times, dtype=np.int64)[order])
    row, col, counts = np.concatenate(rows), np.concatenate(cols), np.concatenate(counts)
    del rows, cols
    vocabulary, n_words = list(ids), len(ids)
    docs_of = np.bincount(col, minlength=n_words)
    features, seen = np.zeros(n_words), np.zeros(p.buckets)
    for start, word, bucket in _in_parts(vocabulary, p.buckets):
        features[start : start + _PART] += np.bincount(word, minlength=len(vocabulary[start : start + _PART]))
        seen += np.bincount(bucket, weights=docs_of[word + start], minlength=p.buckets)
    wanted = seen >= min(p.min_docs, max(2, n // 50))
    kept = [((word + start)[wanted[bucket]].astype(np.int32), bucket[wanted[bucket]].astype(np.int32)) for start, word, bucket in _in_parts(vocabulary, p.buckets)]
    word = np.concatenate([w for w, _ in kept]) if kept else np.zeros(0, np.int32)
    used = np.flatnonzero(wanted)
    number = np.zeros(p.buckets, dtype=np.int32)
    number[used] = np.arange(len(used))
    at = np.concatenate([number[b] for _, b in kept]) if kept else np.zeros(0, np.int32)
    del kept
    share = counts / np.maximum(np.bincount(row, weights=counts * features[col], minlength=n), 1)[row]
    rng = np.random.default_rng(p.seed)
    emb = rng.normal(0, 0.1, (len(used), p.dims))
    soft = rng.normal(0, 1, (p.dims, 2))
    bias = np.zeros(2)
    weight = np.where(y == 1, p.prior / max(1, (y == 1).sum()), (1 - p.prior) / max(1, (y == 0).sum()))[:, None]
    target = np.eye(2)[y]

    def spread(values, source, to, size, by=1.0):
        """Rows ``source`` of ``values``, times ``by``, summed into rows ``to``; a column and ``_CHUNK`` entries at a time for memory."""
        out = np.zeros((size, values.shape[1]))
        for j in range(values.shape[1]):
            column = np.ascontiguousarray(values[:, j])
            for start in range(0, len(to), _CHUNK):
                part = slice(start, start + _CHUNK)
                out[:, j] += np.bincount(to[part], weights=column[source[part]] * (by[part] if isinstance(by, np.ndarray) else by), minlength=size)
        return out

    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (emb, soft, bias)]
    for step in range(1, p.steps + 1):
        words = spread(emb, at, word, n_words)
        docs = spread(words, col, row, n, share) * p.scale
        z = docs @ soft + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        off = (z / z.sum(axis=1, keepdims=True) - target) * weight
        to_words = spread(off @ soft.T * p.scale, row, col, n_words, share)
        grads = (spread(to_words, word, at, len(used)) + p.decay * emb, docs.T @ off, off.sum(axis=0))
        for value, grad, (m, v) in zip((emb, soft, bias), grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(p.buckets)
    weights[used] = emb @ (soft[:, 1] - soft[:, 0]) * p.scale
    return ToxicityModel(weights, float(bias[1] - bias[0]), True)


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), key: str = "doc_id", text: str = "text", label: str = "toxic", usable=None) -> ToxicityModel:
    """Fit, in a task, on a bounded sample of ``labels`` joined to their texts.

    ``usable``: a condition on the label rows' key column, e.g. a fold. Labels
    are sampled before the join, so the texts are filtered by a small broadcast
    list (``max_positive + max_negative`` ids) and never shuffled as a whole.
    """
    rows = labels.select(labels[key].cast("long").alias("k"), labels[label].cast("int").alias("y")).where("k is not null and y in (0, 1)")
    if usable is not None:
        rows = rows.where(usable(F.col("k")))
    rows = rows.groupBy("k").agg(F.max("y").alias("y"))
    picked = [
        (r.k, r.y)
        for y, most in ((1, params.max_positive), (0, params.max_negative))
        for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most).collect()
    ]
    if not picked:
        return fit([], [], params)
    spark = docs.sparkSession
    listed = spark.createDataFrame(picked, "k long, y int")
    found = docs.select(docs[key].cast("long").alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t")).join(F.broadcast(listed), "k")
    small_batches(spark)
    sample = found.groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("k", "y", "t")
    bags = sample.mapInArrow(_bags, "k long, y int, words array<string>, times array<long>")
    got = bags.groupBy().applyInArrow(_learn(params), "weights binary, bias double, fitted boolean").collect()
    return ToxicityModel(np.frombuffer(got[0].weights), got[0].bias, got[0].fitted) if got else fit([], [], params)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 2):
        words, times = zip(*map(bag, texts(batch.column(2))), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=["k", "y", "words", "times"])


def _learn(params: ToxicityParams):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("k").to_numpy())
        words, times = table.column("words"), table.column("times")
        model = fit_bags(((words[k].as_py(), times[k].as_py()) for k in order.tolist()), table.column("y").to_numpy()[order], params)
        release()
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias], "fitted": [model.fitted]})

    return run


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.clear()

    def clear(self):
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.sums, self.counts, self.n = np.zeros(1 << 16), np.zeros(1 << 16), 0

    def batch(self, many: list[str]) -> np.ndarray:
        if len(self.ids) > _MEMO_WORDS:
            self.clear()
        per_doc = []
        for text in many:
            found = _WORD.findall(text.lower())
            per_doc.append(np.fromiter(map(self.ids.__getitem__, found), dtype=np.int64, count=len(found)))
        self.learn()
        lengths = np.array([len(x) for x in per_doc])
        flat = np.concatenate(per_doc) if per_doc else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(many)), lengths)
        sums = np.bincount(owner, weights=self.sums[flat], minlength=len(many))
        counts = np.bincount(owner, weights=self.counts[flat], minlength=len(many))
        logit = sums / np.maximum(counts, 1) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700))) if self.model.fitted else np.zeros(len(many))

    def learn(self, step: int = _PART):
        fresh = list(self.ids)[self.n :] if self.n < len(self.ids) else []
        if len(self.ids) > len(self.sums):
            room = 2 * len(self.ids)
            self.sums = np.concatenate([self.sums, np.zeros(room - len(self.sums))])
            self.counts = np.concatenate([self.counts, np.zeros(room - len(self.counts))])
        for start in range(0, len(fresh), step):
            part = fresh[start : start + step]
            word, bucket = subwords(part, len(self.model.weights))
            at = slice(self.n, self.n + len(part))
            self.sums[at] = np.bincount(word, weights=self.model.weights[bucket], minlength=len(part))
            self.counts[at] = np.bincount(word, minlength=len(part))
            self.n += len(part)


def scores(model: ToxicityModel, many: list[str]) -> np.ndarray:
    return _Scorer(model).batch(many)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", rows_at_once: int = 512) -> DataFrame:
    """``docs`` with the column ``score`` (0 to 1) added; one narrow pass."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.fitted))
    docs = docs.drop(score)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, fitted = held.value
        scorer = _Scorer(ToxicityModel(weights.astype(np.float64), bias, fitted))
        for batch in parts(batches, at, max_rows=rows_at_once):
            got = pa.array(scorer.batch(texts(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, score])
        scorer.clear()

    return docs.mapInArrow(run, with_field(docs, score, "double"))
