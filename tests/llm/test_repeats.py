"""Removal of repeated passages against a dictionary of all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def got(df, **how):
    rows = repeats.remove_repeats(df, **how).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    return Counter(tuple(r) for r in rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(repeats.plain([(r.doc_id, r.text) for r in docs.collect()]))
    assert got(docs) == want and sum(w[2] * n for w, n in want.items()) > 1000
    assert got(docs.repartition(7), block_bytes=20_000) == want


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    stock = [[rng.choice("abc") for _ in range(rng.randint(1, 40))] for _ in range(6)]
    rows = [(rng.choice([None, *range(12)]), " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(stock))) for _ in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for window in (1, 5, 20):
        assert got(df, window=window, block_bytes=500) == Counter(repeats.plain(rows, window))


def test_a_narrow_sketch_loses_nothing(spark, monkeypatch):
    """Counts that are far too high only send more windows to the exact groups."""
    monkeypatch.setattr(repeats, "CELLS_PER_WINDOW", 1e-9)
    rows = [(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(50))) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == Counter(repeats.plain(rows))


def test_ranges_and_groups(spark):
    rows = [(i, " ".join(f"w{(i % 20) * 30 + j}" for j in range(60))) for i in range(80)]
    assert got(spark.createDataFrame(rows, SCHEMA), block_bytes=3000, range_bits=6, names_per_group=50) == Counter(repeats.plain(rows))


def test_odd_rows(spark):
    page = " ".join(f"w{j}" for j in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, page), (4, page), (None, page), (None, None), (5, "w 1 " + page), (6, page.replace(" ", "\n\t")), (7, page + " " + "x " * 30_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("block", F.lit(1))
    assert got(df) == Counter(repeats.plain(rows))
    assert got(df.where("false")) == Counter() and repeats.remove_repeats(df).columns == ["doc_id", "text", "n_words", "n_removed"]


def test_hot_page_is_one_entry_a_block(spark):
    page = " ".join(f"w{j}" for j in range(40))
    blocks = repeats.pack(spark.createDataFrame([(i, page) for i in range(400)], SCHEMA).coalesce(1), block_bytes=4_000)
    bodies = [bytes(r.body) for r in blocks.orderBy("block").collect()]
    assert len(bodies) > 3 and sum(r.windows for r in blocks.collect()) == 400 * 21
    assert all(len(np.unique(c)) == 21 for b in bodies for c in repeats._Block(b, 20).cells(40))


def test_gaps_round_trip():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(0, 1 << int(b), int(n), dtype=np.uint64)) for b, n in [(3, 9), (62, 5), (20, 0), (24, 1000)]]
    numbers, counts = repeats.ungaps([repeats.gaps(x) for x in lists])
    assert counts.tolist() == [len(x) for x in lists] and (numbers == np.concatenate(lists)).all()
    assert repeats.ungaps([])[0].size == 0
