"""Periodic runs against a comparison of each document with itself at every distance."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import periodic
from tonegrid.llm.queries import op13_periodic_runs

SF = "/root/testdata/sf0.001"


def text(rng):
    """Words of a small alphabet, with repeated stretches of many periods, also of periods inside periods."""
    n, letters, out = rng.randint(0, 160), rng.choice([1, 2, 3, 5, 30]), []
    while len(out) < n:
        if rng.random() < 0.6:
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.4:
                unit = (unit[:3] * 10)[: len(unit)]
            out += (unit * 9)[: int(len(unit) * rng.uniform(1, 8))]
        else:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
    return out


def split(found, counts):
    a, b, q = found
    ends = np.cumsum(counts)
    out = [[] for _ in counts]
    for x, y, z, i in zip(a, b, q, np.searchsorted(ends, a, side="right"), strict=True):
        out[i].append((int(x - ends[i] + counts[i]), int(y - x), int(z)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_random_documents(seed):
    rng = random.Random(seed)
    for _ in range(60):
        docs = [text(rng) for _ in range(rng.randint(1, 6))]
        counts = np.array([len(d) for d in docs])
        assert split(periodic.runs_of(np.array([w for d in docs for w in d], np.int64), counts), counts) == [periodic.plain(d) for d in docs]


def test_fibonacci_and_progressions():
    """Words full of squares; a block that occurs three times beside itself inside a longer period."""
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    unit = [1] * 9 + [2] + [1] * 9 + [3] * 2
    for doc in (b, unit * 6, ([7] * 40 + [8]) * 5, [1, 2] * 30 + [1, 3], ([1, 2] * 12 + [3]) * 4 + [1, 2] * 12):
        counts = np.array([len(doc)])
        assert split(periodic.runs_of(np.array(doc, np.int64), counts), counts) == [periodic.plain(doc)]


def test_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    left = rng.integers(0, 500, 400)
    right = np.minimum(500, left + rng.integers(0, 60, 400))
    x = rng.integers(0, 520, 400)
    got = periodic.Wavelet(values).successor(left, right, x, 999)
    assert got.tolist() == [min((v for v in values[a:b].tolist() if v >= y), default=999) for a, b, y in zip(left, right, x, strict=True)]


def test_suffix_array():
    rng = random.Random(3)
    docs = [[rng.randrange(2) for _ in range(n)] for n in (40, 1, 33)]
    words = np.array([10 * i + w for i, d in enumerate(docs) for w in d])
    ends = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
    begin = np.repeat(np.cumsum([0, *[len(d) for d in docs[:-1]]]), [len(d) for d in docs])
    got = periodic.Suffixes(words, begin, ends).array.tolist()
    assert got == sorted(range(len(words)), key=lambda i: words[i : ends[i]].tolist())


def by_hand(doc_id, body):
    words = [w for w in (body or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_planted_tails_and_collapsed_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = periodic.find_runs(docs.select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text")))
    rows = {r.doc_id: r for r in found.collect()}
    for d in docs.collect():
        words, row = by_hand(d.doc_id, d.text), rows[d.doc_id]
        runs = periodic.plain(words)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert [tuple(r) for r in row.runs] == runs and row.n_words == len(words)
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert sum(len(r.runs) for r in rows.values()) > 5


def test_odd_rows(spark):
    long = "a b c d e f g h i " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x x x x x"), (5, "x x x x x x"), (5, "x x x x x x"), (None, "x " * 9), (6, long), (7, "ä ß ä ß ä ß ä ß")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.n_words, len(r.collapsed)) for r in periodic.find_runs(df).collect()), key=str)
    assert got == sorted([(1, [], 0, 0), (2, [], 0, 0), (3, [], 0, 0), (4, [], 5, 9), (5, [(0, 6, 1)], 6, 1), (5, [(0, 6, 1)], 6, 1), (0, [(0, 9, 1)], 9, 1), (6, [(0, 180_000, 9)], 180_000, 17), (7, [(0, 8, 2)], 8, 3)], key=str)
    assert periodic.find_runs(df.where("false")).count() == 0 and periodic.find_runs(df).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_periodic_runs(spark, str(tmp_path)).collect() == []
