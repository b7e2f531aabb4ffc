"""Near-duplicate texts by SimHash and the Jaccard similarity of their word-shingle sets (the pipeline's stage).

Two texts are linked where the sets of their five-word shingles are similar by
0.8 or more; groups are what the links connect. Candidates are texts whose
SimHash fingerprints, those of operator 8, are within three bits; the exact
similarity of the sets decides. A pair at 0.8 differs in about ten bits, beyond
the Hamming balls, so groups that fingerprints leave apart meet by MinHash bands
as well (32 bands of 5 minima: a pair at exactly 0.8 misses all of them with
probability 3e-6), under the same exact similarity.

Plan
    1. fingerprints and signatures in one pass (numpy); copies of a text are one
       node, the hash of the text, so they add neither members nor pairs.
    2. all fingerprints meet in half-radius balls (``simhash.links``). A link of
       two fingerprints pairs their smallest nodes, and the other nodes of a
       fingerprint pair with its smallest: a star, never all pairs. Pairs that
       are similar enough make the first groups.
    3. band keys that nodes of two groups or more share give the members; the
       shingle sets of members and of the pairs of 2 only are written once.
    4. in ``STARS`` rounds, the member of every band key that has the most
       company meets the others whose group is not its own yet. It has met
       everyone and leaves; keys whose members are all in one group are done.
    5. what is left is bounded before it is compared. Only shingles that a second
       text among them holds can be shared: with c of them among n, two texts
       cannot be more similar than min(c) / (n + n' - min(c)). Members that
       cannot reach 0.8 with anyone of their key leave. The others meet in
       blocks of a key, inside a task, where pairs of one group, pairs beyond
       the bound and pairs of an earlier key are passed over. Pairs are never
       rows; only links are.

No candidate pair is skipped unless its texts are in one group already or cannot
be similar.

Cases: null and empty texts are one node; texts without words are equal sets;
texts of fewer than five words have one shingle, the whole sequence; very long
texts are compared whole, and blocks are also bounded by shingles; repeated rows
are one node; an empty table gives no rows; other columns are ignored. A node
is 64 bits: two different texts of 10^9 share one with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, cut, parts, release, small_batches, texts
from .simhash import SEED, _majority, components, links

SHINGLE = 5
#: Words in a shingle of a fingerprint, as in operator 8.
PRINT_SHINGLE = 3
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: Rounds of one centre a band key.
STARS = 2
#: Members and shingles of a block of a band key.
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1 << 18

_CONSTANTS = np.random.default_rng(SEED).integers(0, 1 << 64, size=(3, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_FLIP, _FACTOR, _WEIGHT = _CONSTANTS
_SALT = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def text_node(text):
    """The node of a text column."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``; never empty."""
    return _set_of(ascii_lower_words(text))


def _set_of(words: list[bytes]) -> np.ndarray:
    joined = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], dtype="<u8"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; sets that agree on the band's minima have equal keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 1024):
        part = hashes[start : start + 1024]
        np.minimum(least, ((part ^ _FLIP[:, None]) * _FACTOR[:, None]).min(axis=1), out=least)
    return (least * _WEIGHT).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) ^ _SALT


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 1):
        sets, prints = [], []
        for words in map(ascii_lower_words, texts(batch.column(1))):
            sets.append(_set_of(words))
            prints.append(_majority(words, PRINT_SHINGLE))
        keys = [band_keys(s).view(np.int64) for s in sets]
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "n", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).view(np.int64) for t in texts(batch.column(1))], pa.list_(pa.int64()))], names=["node", "shingles"])


def _arrays(column) -> list[np.ndarray]:
    """The lists of an Arrow column as numpy arrays, without copies."""
    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        out += np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1]) if len(chunk) else []
    return out


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [similarity(x, y) >= SIMILARITY for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))
    release()


def _within(low, n, other_n):
    """Whether ``low`` shared shingles at most leave room for the similarity."""
    return low >= SIMILARITY * (n + other_n - low) - 1e-6


def _meet(table: pa.Table) -> pa.Table:
    """Links between the members of one block, or of two blocks, of a band key."""
    key = table.column("key")[0].as_py()
    node, root, n, c, block = (table.column(x).to_numpy() for x in ("node", "root", "n", "c", "block"))
    keys, sets = np.stack(_arrays(table.column("keys"))), _arrays(table.column("shingles"))
    group = {r: r for r in root.tolist()}

    def find(r):
        while group[r] != r:
            group[r] = r = group[group[r]]
        return r

    a, b = [], []
    two = table.column("i")[0] != table.column("j")[0]
    for i in range(len(node)):
        low = np.minimum(c[i], c)
        open_ = (node > node[i]) & (root != root[i]) & _within(low, n[i], n)
        if two:
            open_ &= block != block[i]
        for j in np.flatnonzero(open_):
            if find(int(root[i])) == find(int(root[j])) or keys[i][np.argmax(keys[i] == keys[j])] != key:
                continue  # in one group by now, or met under an earlier key
            if similarity(sets[i], sets[j]) >= SIMILARITY:
                a.append(node[i])
                b.append(node[j])
                group[find(int(root[i]))] = find(int(root[j]))
    out = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    release()
    return out


def _mixed(members: DataFrame) -> DataFrame:
    """The members of band keys that hold more than one group."""
    keys = members.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    return members.join(keys, "key", "left_semi")


def _regrouped(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return members
    return members.drop("root").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members (key, node, n, root) that step 5 of the plan finds."""
    left = members.select("node", "n").distinct()
    held = sets.join(left, "node", "left_semi")
    each = held.select("node", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("_k")).where("_k > 1").select("shingle")
    counted = each.join(common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("c"))
    able = cut(members.join(counted, "node").where(_within(F.col("c"), F.col("n"), F.col("c"))), "able-members")
    best = able.groupBy("key").agg(F.max("c").alias("_c"), F.min("n").alias("_n"))
    able = able.join(best, "key").where(_within(F.least("c", "_c"), F.col("n"), F.col("_n"))).drop("_c", "_n")
    able = cut(_mixed(able), "able-members")
    sizes = able.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = able.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = placed.select("key", "node", "n", "c", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return placed.join(sets.select("node", "keys", "shingles"), "node").groupBy("key", "i", "j").applyInArrow(_meet, "a long, b long")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, a_n, b_n) of ``nodes`` (node, n, fp) that step 2 of the plan compares, the smaller node first."""
    first = F.min(F.struct("node", "n")).alias("top")
    tops = cut(nodes.groupBy("fp").agg(first, F.count("*").alias("_nodes")), "fingerprint-tops")
    shared = nodes.join(tops.where("_nodes > 1"), "fp").where("node <> top.node").select("top", F.struct("node", "n").alias("other"))
    left, right = (tops.select(F.col("fp").alias(side), F.col("top").alias(name)) for side, name in (("a", "top"), ("b", "other")))
    met = shared.unionByName(links(tops).join(left, "a").join(right, "b").select("top", "other"))
    low, high = F.least("top", "other"), F.greatest("top", "other")
    return met.select(low["node"].alias("a"), high["node"].alias("b"), low["n"].alias("a_n"), high["n"].alias("b_n"))


def band_members(nodes: DataFrame) -> DataFrame:
    """(key, node, n, _members) of the band keys that two nodes or more share."""
    banded = nodes.select(F.explode("keys").alias("key"), "node", "n")
    return banded.join(banded.groupBy("key").agg(F.count("*").alias("_members")).where("_members > 1"), "key")


def _able(a_n, b_n):
    """Sets whose sizes differ by more cannot be similar."""
    return F.least(a_n, b_n) >= SIMILARITY * F.greatest(a_n, b_n) - 1e-6


def _judge(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left, right = (sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_shingles")) for side in ("a", "b"))
    judged = pairs.join(left, "a").join(right, "b").select("a", "b", "a_shingles", "b_shingles")
    return judged.mapInArrow(_similar, "a long, b long")


def _united(groups: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """The groups with the links ``found``; the stars of earlier groups stand for their links. None while there is no link."""
    if not found.head(1):
        return groups
    if groups is not None:
        found = found.unionAll(groups.select(F.col("root").alias("a"), F.col("node").alias("b")))
    return cut(components(found), "groups")


def similar_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) of every text of ``docs`` that is in a group of two texts or more; root is the group's smallest node."""
    small_batches(docs.sparkSession)
    source = docs.select(text_node(docs[text]).alias("node"), docs[text].cast("string").alias("_text"))
    signed = source.mapInArrow(_sign, "node long, n long, keys array<long>, fp long")
    nodes = cut(signed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "signatures")
    near = cut(print_pairs(nodes.select("node", "n", "fp")).where(_able(F.col("a_n"), F.col("b_n"))).select("a", "b").distinct(), "fingerprint-pairs")
    members = cut(band_members(nodes), "members")
    company = members.groupBy("node").agg(F.sum("_members").alias("company"))
    members = cut(members.drop("_members").join(company, "node"), "members")
    compared = members.select("node").unionAll(near.select("a")).unionAll(near.select("b")).distinct()
    each = source.groupBy("node").agg(F.first("_text").alias("_text")).join(compared, "node", "left_semi")
    hashed = each.mapInArrow(_sets, "node long, shingles array<long>")
    sets = cut(hashed.join(nodes.select("node", "keys"), "node"), "shingle-sets")
    found = cut(_judge(near, sets), "similar")
    groups = _united(None, found)
    members = cut(_mixed(_regrouped(members.withColumn("root", F.col("node")), groups)), "members")
    for _ in range(STARS):
        if not members.head(1):
            break
        order = F.struct("company", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("root").alias("b_root"))
        met = members.join(members.groupBy("key").agg(F.max(order).alias("m")), "key").select("key", "node", "n", "root", "company", "m.b", "m.b_n", "m.b_root").where("node <> b")
        open_pairs = met.where("root <> b_root").where(_able(F.col("n"), F.col("b_n")))
        pairs = open_pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        groups = _united(groups, cut(_judge(pairs, sets), "similar"))
        members = cut(_mixed(_regrouped(met.select("key", "node", "n", "root", "company"), groups)), "members")
    if members.head(1):
        groups = _united(groups, cut(_in_blocks(members.select("key", "node", "n", "root"), sets), "similar"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")) if groups is None else groups
