"""Benchmark decontamination by SimHash windows (operator 10), DataFrame functions only.

Every window of a document that is as long as a benchmark item is a candidate
copy. Its weighted word-shingle set (five words, multiplicity as weight) has a
64-bit SimHash; multi-index blocks (``radius + 1`` of them, so that fingerprints
within the radius agree on one whole block) find the items in reach, and the
exact weighted Jaccard similarity decides (0.8 or more).

Which windows are hashed: a window similar to an item by 0.8 misses at most a
ninth of its shingles. It can slide right to its first shared shingle without
losing a shared one, so windows that start at a shared shingle (clamped to the
document's end) and miss no more than that are enough: no similar window is
lost, and text without benchmark shingles costs one hash probe a word.

Plan: one narrow stage over whole texts — word hashes, shingle hashes, probe of
the benchmark's shingles, overlap test — and only surviving windows are
shuffled. The benchmark side is broadcast in blocks of about
``block_shingles`` shingles, once as (shingle, item) and once as whole items, so
bytes grow with the shingles; a larger benchmark takes more blocks, each with
its own pass, and never a larger broadcast.

Radius: windows at similarity 0.8 have an expected distance near 10 bits with a
deviation near 3. Of a million simulated windows at exactly 0.8 a radius of 19
loses up to 0.07 %, the default of 26 none. At such a radius the blocks are two
or three bits wide and pass most windows on; what selects is the shared shingle
(figures in the README).

Cases: null or empty texts hold nothing; very long texts are probed whole; an
empty table gives no rows, an empty benchmark marks nothing; items of fewer than five words have no
shingle and match nothing; a document shorter than an item is one window;
repeated rows get one result each; equal items are all reported; clashing column
names do not matter, as only key and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, cut

SHINGLE = 5
RADIUS = 26
SIMILARITY = 0.8
BLOCK_SHINGLES = 500_000


def _word_hashes(text):
    """Array of word hashes of a lower-cased text column, empty for texts without words."""
    bare = F.lower(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r")))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, WORD_SPLIT), lambda w: F.xxhash64(w)))


def _once(value):
    """``value`` computed once a row: as a generator's output it is not copied into the expressions that read it."""
    return F.explode_outer(F.array(value))


def _shingle_at(words: str, at: str) -> str:
    return f"xxhash64({', '.join(f'{words}[{at} + {k}]' for k in range(SHINGLE))})"


def _shingles(words: str) -> str:
    """SQL for the shingle hashes of an array of word hashes."""
    return f"if(size({words}) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, greatest(0, size({words}) - {SHINGLE})), i -> {_shingle_at(words, 'i')}))"


def _simhash(shingles: str) -> str:
    """SQL for the SimHash: bit counts in two 32-bit lanes of a long, for bits k and k + 32."""
    sums = f"transform(sequence(0, 31), k -> aggregate({shingles}, 0L, (s, x) -> s + (shiftrightunsigned(x, k) & 4294967297L)))"
    bits = "if(2 * (s & 4294967295L) > n, shiftleft(1L, k), 0L) | if(2 * shiftrightunsigned(s, 32) > n, shiftleft(1L, k + 32), 0L)"
    return f"aggregate(transform({sums}, (s, k) -> struct(s as s, k as k, size({shingles}) as n)), 0L, (f, b) -> f | {bits.replace('(s &', '(b.s &').replace('unsigned(s,', 'unsigned(b.s,').replace('> n', '> b.n').replace('1L, k', '1L, b.k')})"


def _blocks(fingerprint: str, radius: int):
    """Array of (block, value); fingerprints within ``radius`` bits share an element."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    parts = [f"struct({k} as block, shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L as value)" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.expr(f"array({', '.join(parts)})")


#: Sum of the smaller multiplicities over the distinct shingles of two arrays.
_COMMON = "aggregate(array_intersect(w_shingles, i_shingles), 0, (s, x) -> s + least(size(filter(w_shingles, y -> y = x)), size(filter(i_shingles, y -> y = x))))"


def benchmark_items(benchmark: DataFrame, key: str = "item_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per item of five words or more: shingles, fingerprint, blocks."""
    return (
        benchmark.select(benchmark[key].alias("item_id"), _once(_word_hashes(benchmark[text])).alias("words"))
        .where(F.size("words") >= SHINGLE)
        .select("item_id", F.size("words").alias("n"), _once(F.expr(_shingles("words"))).alias("i_shingles"))
        .select("item_id", "n", "i_shingles", _once(F.expr(_simhash("i_shingles"))).alias("i_fp"))
        .withColumn("i_blocks", _blocks("i_fp", radius))
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, text_hash, item_id, start, similarity): the best window of every item found in a text."""
    items = cut(benchmark_items(benchmark, item_key, item_text, radius).withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    total = items.agg(F.coalesce(F.sum(F.size("i_shingles")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // block_shingles))
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    words = docs.select(docs[key].alias("doc_id"), F.xxhash64(body).alias("text_hash"), _once(_word_hashes(docs[text])).alias("w"))
    places = F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(0), F.size("w") - SHINGLE))
    probes = words.select("doc_id", "text_hash", "w", F.explode_outer(places).alias("pos")).withColumn("shingle", F.expr(f"if(pos is null, null, {_shingle_at('w', 'pos')})"))
    miss = (1 - similarity) / (1 + similarity)  # the share of shingles that a similar set of the same size may lack
    found = None
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        index = mine.select("item", F.explode(F.array_distinct("i_shingles")).alias("shingle"))
        whole = mine.select("item", "n", "i_shingles", F.size("i_shingles").alias("m"))
        hits = probes.join(F.broadcast(index), "shingle").join(F.broadcast(whole), "item")
        placed = hits.select("doc_id", "text_hash", "w", "n", "m", "i_shingles", F.greatest(F.lit(0), F.least("pos", F.size("w") - F.col("n"))).alias("start"))
        inside = F.expr(f"transform(sequence(start, start + least(n, size(w)) - {SHINGLE}), i -> {_shingle_at('w', 'i')})")
        windows = placed.select("doc_id", "text_hash", "start", "n", "m", "i_shingles", _once(inside).alias("w_shingles"))
        # a document shorter than the item is one short window, which may lack a larger share
        lacking = F.floor(F.col("m") * F.when(F.size("w_shingles") < F.col("m"), 1 - similarity).otherwise(miss) + 1e-9)
        enough = F.size(F.array_intersect("w_shingles", "i_shingles")) >= F.size(F.array_distinct("i_shingles")) - lacking
        close = F.size("w_shingles") >= F.col("m") * similarity - 1e-9
        kept = windows.where(close & enough).select("doc_id", "text_hash", "start", "n", "w_shingles")
        found = kept if found is None else found.unionAll(kept)
    candidates = found.groupBy("doc_id", "text_hash", "start", "n").agg(F.first("w_shingles").alias("w_shingles"))
    hashed = candidates.select("*", _once(F.expr(_simhash("w_shingles"))).alias("w_fp"))
    left = hashed.select("doc_id", "text_hash", "start", "n", "w_shingles", "w_fp", F.explode(_blocks("w_fp", radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    right = items.select("item_id", "n", "i_shingles", "i_fp", F.explode("i_blocks").alias("b")).select("item_id", "n", "i_shingles", "i_fp", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    near = left.join(right, ["n", "block", "value"]).where(F.bit_count(F.col("w_fp").bitwiseXOR(F.col("i_fp"))) <= radius)
    # the first block on which a pair agrees speaks for it, so a pair is verified once
    differ = [f"(shiftrightunsigned(w_fp ^ i_fp, {64 * k // (radius + 1)}) & {(1 << (64 * (k + 1) // (radius + 1) - 64 * k // (radius + 1))) - 1}L) <> 0" for k in range(radius + 1)]
    first = F.expr("case " + " ".join(f"when not ({d}) then {k}" for k, d in enumerate(differ)) + " end")
    verified = near.where(F.col("block") == first).select("*", _once(F.expr(_COMMON)).alias("common"))
    scored = verified.withColumn("similarity", F.col("common") / (F.size("w_shingles") + F.size("i_shingles") - F.col("common"))).where(F.col("similarity") >= similarity - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    return scored.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select("doc_id", "text_hash", "item_id", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity"))


def by_text(found: DataFrame) -> DataFrame:
    """One row per contaminated (doc_id, text_hash): item count and the best item (ties: the smallest id)."""
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("item_id").alias("i")))
    grouped = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), best.alias("b"))
    return grouped.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "n_items", F.col("b.i").alias("item_id"), (-F.col("b.s")).alias("similarity"))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("__leak_hash", F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, similarity) of every row of ``docs``."""
    marks = by_text(leaks(docs, benchmark, key, text, **options))
    rows = docs.select(docs[key].alias("doc_id"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("__leak_hash"))
    joined = rows.join(marks, rows["doc_id"].eqNullSafe(marks["_doc"]) & (rows["__leak_hash"] == marks["_hash"]), "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose texts hold no benchmark item."""
    marks = by_text(leaks(docs, benchmark, key, text, **options)).select("_doc", "_hash")
    rows = _keyed(docs, key, text)
    return rows.join(marks, rows[key].eqNullSafe(marks["_doc"]) & (rows["__leak_hash"] == marks["_hash"]), "left_anti").drop("__leak_hash")
