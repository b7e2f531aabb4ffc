"""The near-duplicate stage against brute force over all pairs."""

import random

import corpus_pipeline
from tonegrid.llm import minhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited_texts(rng):
    """Texts of 60 to 400 words with copies edited in up to 3 percent of their words, so similarities lie on both sides of 0.8."""
    out = []
    for _ in range(40):
        base = ["".join(rng.choice("abcdefghijklm") for _ in range(4)) for _ in range(rng.randint(60, 400))]
        for _ in range(5):
            words = list(base)
            for at in rng.sample(range(len(base)), rng.randint(0, len(base) // 30)):
                words[at] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out


def test_stage_equals_brute_force(spark):
    rng = random.Random(5)
    texts = edited_texts(rng)
    # a chain whose ends are far apart, a group that shares half of every text, and odd texts
    chain = [f"link{k}" for k in range(200)]
    texts += [" ".join(chain[8 * k : 8 * k + 120]) for k in range(9)]
    half = " ".join(f"half{k}" for k in range(60))
    texts += [half + " " + " ".join(f"own{i}x{k}" for k in range(60)) for i in range(40)]
    texts += ["", " \n", "one two", "One  Two", "one two three", texts[0], texts[0].upper()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_groups(texts)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(want)
    assert 60 < len(set(want)) < len(texts) - 60


def test_bands_reach_the_threshold():
    rng = random.Random(6)
    missed = 0
    for _ in range(500):
        pool = [rng.getrandbits(64) for _ in range(100)]
        a, b = (minhash.np.unique(minhash.np.array(x, dtype="<u8")) for x in (pool[:90], pool[10:]))
        assert minhash.similarity(a, b) == 0.8
        missed += not (minhash.band_keys(a) == minhash.band_keys(b)).any()
    assert missed == 0


def test_fingerprints_find_and_sets_decide(spark, monkeypatch):
    """without any band the stage links what SimHash fingerprints bring within three bits, and nothing that is less similar than 0.8."""
    from pyspark.sql import functions as F

    from tonegrid.llm import simhash

    own, rng = minhash.band_members, random.Random(8)
    monkeypatch.setattr(minhash, "band_members", lambda nodes: own(nodes.where("false")))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    pairs = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(100, 300))]
        pairs.append((" ".join(base), " ".join(base[:50] + [word()] + base[51:])))
    refrain = " ".join(word() for _ in range(11)) + " "
    pairs += [tuple(refrain * 80 + " ".join(word() for _ in range(20)) for _ in range(2)) for _ in range(3)]
    texts = [t for p in pairs for t in p]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = dict(docs.select("doc_id", minhash.text_node(F.col("text"))).collect())
    root = {r.node: r.root for r in minhash.similar_texts(docs).collect()}
    bits = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for a, b in pairs]
    alike = [len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for a, b in pairs]
    want = [near <= 3 and same for near, same in zip(bits, alike, strict=True)]
    assert [nodes[2 * k] in root and root[nodes[2 * k]] == root.get(nodes[2 * k + 1]) for k in range(len(pairs))] == want
    assert 5 < sum(want) < 40 and max(bits[40:]) <= 3 and not any(alike[40:])
