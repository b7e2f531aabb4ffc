"""The index of grams against all pairs, and the ratio against the standard library's."""

import random
from difflib import SequenceMatcher

import pytest

from tonegrid.operators import fuzzy, recall


def words(rng, n, letters="abcd", size=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_ratio_equals_the_library():
    rng = random.Random(1)
    for a, b in zip(words(rng, 3000, "abc", 12), words(rng, 3000, "abc", 12), strict=True):
        assert fuzzy.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert fuzzy.ratio("bananna", "banana") == pytest.approx(12 / 13)


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_best_near_equals_all_pairs(spark, threshold):
    rng = random.Random(2)
    pool = words(rng, 150) + words(rng, 40, "abcdefgh", 14) + ["", "abab", "abab"]
    said = sorted(set(words(rng, 200) + words(rng, 60, "abcdefgh", 14) + [w[1:] + "a" for w in pool[150:]]))
    items = spark.createDataFrame([(w, i) for i, w in enumerate(pool)], "norm string, pool_index int").repartition(3)
    asked = spark.createDataFrame([(w,) for w in [*said, None]], "norm string").repartition(3)
    got = {r.norm: (r.score, r.pool_index) for r in fuzzy.best_near(asked, items, threshold).collect()}
    want = {}
    for w in said:
        score, at = max((SequenceMatcher(None, w, p).ratio(), -i) for i, p in enumerate(pool))
        if score >= threshold and w:
            want[w] = (score, -at)
    assert got == want and len(want) > 10
    pairs = {(r.norm, r.item_norm) for r in fuzzy.near_pairs(asked.where("norm is not null"), items.select("norm").distinct(), threshold).collect()}
    assert len(pairs) < 0.7 * len(said) * len(set(pool))


def test_best_any_meets_the_pool_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(recall, "MAX_POOL", 17)
    rng = random.Random(3)
    pool = words(rng, 80, "abcdef", 8)
    said = sorted({w for w in words(rng, 90, "abcxyz", 8) if w})
    table = spark.createDataFrame([(w, i, w) for i, w in enumerate(pool)], "norm string, pool_index int, item string")
    asked = spark.createDataFrame([(w,) for w in said], "norm string")
    want = {w: max((SequenceMatcher(None, w, p).ratio(), -i) for i, p in enumerate(pool)) for w in said}
    for found in (recall.best_any(asked, table), recall.best_fuzzy(asked, table)):
        assert {r.norm: (r.score, -r.pool_index) for r in found.collect()} == want
    only_near = {r.norm for r in recall.best_fuzzy(asked, table, below=False).collect()}
    assert only_near == {w for w, (s, _) in want.items() if s >= 0.8}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "norm string, pool_index int, item string")
    some = spark.createDataFrame([("abc", 0, "abc")], "norm string, pool_index int, item string")
    assert fuzzy.best_near(some, none, 0.8).count() == 0 and recall.best_fuzzy(some, none).count() == 0 and recall.best_fuzzy(none, some).count() == 0
