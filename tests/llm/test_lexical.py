"""Ranked search against scoring every document."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import lexical

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def got(docs, items, **how):
    rows = lexical.search(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_one_block(seed):
    """The best-first search alone: many ties, items with repeats, lists of every length."""
    rng = random.Random(seed)
    for wide in (1, 3, 32):
        n = rng.randint(1, 90)
        post = sorted({(rng.randrange(9) ** 2 // 9, rng.randrange(n)) for _ in range(rng.randint(1, 250))})
        term, doc = (np.array(x, np.int64) for x in zip(*post, strict=True))
        impact = np.array([rng.choice([1, 2, 2, 5, 40]) for _ in post], np.int64)
        asked = [{rng.randrange(9): rng.randint(1, 3) for _ in range(rng.randint(0, 5))} for _ in range(7)]
        k = rng.choice([1, 4, 20])
        item, found, score = lexical.best(lexical.Lists(term, doc, impact, n), asked, k, wide)
        for i, own in enumerate(asked):
            total = np.zeros(n, np.int64)
            for t, c in own.items():
                np.add.at(total, doc[term == t], c * impact[term == t])
            want = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s > 0))[:k]
            mine = [(-s, d) for s, d in zip(score[item == i].tolist(), found[item == i].tolist(), strict=True) if s > 0]
            assert mine == want


def test_intervals_are_dropped(monkeypatch):
    """One document holds all terms of an item: few intervals are opened."""
    rng = np.random.default_rng(4)
    post = sorted({(t, int(d)) for t in range(30) for d in rng.choice(20_000, 400, replace=False)} | {(t, 777) for t in range(30)})
    term, doc = (np.array(x, np.int64) for x in zip(*post, strict=True))
    lists = lexical.Lists(term, doc, rng.integers(50, 100, len(post)), 20_000)
    opened, first = [], lexical._Frontier.__init__

    def count(self, lists, item, *rest):
        opened.append(len(item))
        first(self, lists, item, *rest)

    monkeypatch.setattr(lexical._Frontier, "__init__", count)
    _, found, _ = lexical.best(lists, [dict.fromkeys(range(30), 1)], k=1, wide=8)
    assert found.tolist() == [777] and sum(opened) < 6000


def test_whole_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(lexical.plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]), key=str)
    assert got(docs, items) == want and len(want) > 400
    assert got(docs.repartition(6), items, block_docs=7, max_terms=60) == want
    assert got(docs, items, k=3) == [w for w in want if w[1] <= 3]


def test_terms():
    assert [t.decode() for t in lexical.terms("Don't STOP\x85 the_2nd-Ünï `x`{y}[Z]@")] == ["don", "t", "stop\x85", "the", "2nd", "Ünï", "x", "y", "z"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (5, "beta " * 50_000), (6, "alpha " + "x " * 40_000), (7, "gamma")]
    asked = [(1, "Alpha alpha BETA"), (1, "gamma"), (2, None), (3, "nowhere"), (None, "x"), (4, "alpha " * 3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).repartition(3)
    items = spark.createDataFrame(asked, ITEMS).withColumn("rank", F.lit("clash"))
    assert got(docs, items) == sorted(lexical.plain(rows, asked), key=str)
    assert got(docs.where("false"), items) == [] and got(docs, items.where("false")) == []
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
