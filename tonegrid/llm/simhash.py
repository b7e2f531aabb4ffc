"""SimHash near-duplicates by meeting in the middle of Hamming balls (operator 8).

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Two
fingerprints at most three bits apart must meet: seen as bit sets, write A and
B for the bits only one of them has (|A| + |B| ≤ 3). Clearing A in the first
and B in the second gives the same set, and none needs more than two clears
unless B is empty and |A| = 3; then two clears of the first are one set bit of
the second. So every fingerprint emits itself, its 64 one-bit neighbours and
the sets with two bits cleared: about 560 of the 2 081 points within two bits,
and still every linked pair shares a variant whose levels add up to 3 or less.

Plan
    1. fingerprints in one pass (numpy), equal fingerprints grouped with a
       map-side aggregate: copies cost nothing further.
    2. variants are emitted in numpy, packed by bucket of a hash of the variant
       and shuffled as blobs; the bucket number follows the count of distinct
       fingerprints, so a bucket has a bounded share of evenly hashed variants.
    3. in a bucket, equal variants meet. Members of level 0 or 1 are within two
       bits of each other, and members of level 2 within three of those. All are
       tied to the smallest light member: a star of true links, never all pairs,
       that keeps every component whole. Links are verified by bit count.
    4. components by alternating large-star and small-star rounds over the
       links, each cut by a written table, until the links are stars.
    5. rows meet the component of their fingerprint; fingerprints that more than
       ``HOT_ROWS`` rows (and more than a thousandth of all) have are at most a
       thousand, and their rows meet them by a broadcast instead of a shuffle.

Cases: null and empty texts have fingerprint zero and link like any other;
texts of one or two words have one shingle, the whole sequence; very long texts
are hashed whole, in slices; repeated rows keep one output row each; null keys
never name a component unless all keys of it are null; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ascii_lower_words, cut, parts, small_batches, texts

SEED = 42
RADIUS = 3
#: Variants aimed at in a bucket (nine bytes each).
BUCKET_VARIANTS = 1 << 18
#: Fingerprints that one task turns into variants (about 560 each, five MB a thousand).
EMIT_PRINTS = 4096
#: Rows of one fingerprint from which it counts as hot.
HOT_ROWS = 10_000

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PAIRS = (lambda i: _BITS[i[0]] | _BITS[i[1]])(np.triu_indices(64, 1))
_CHANGES = np.concatenate([np.zeros(1, np.uint64), _BITS, _PAIRS])
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_GATHER = np.uint64(pow(int(_SPREAD), -1, 1 << 64))


def _majority(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    if len(words) < shingle:
        joined = [b" ".join(words)]
    elif shingle == 1:
        joined = words
    else:
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in joined], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: str, shingle: int = 3) -> int:
    """Fingerprint as an unsigned 64-bit integer."""
    return _majority(ascii_lower_words(text), shingle)


def add_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", **shingles: int) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, for every named shingle size, a fingerprint as a signed long; one pass."""
    small_batches(docs.sparkSession)
    source = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, len(keep)):
            found = np.array([[_majority(words, k) for k in shingles.values()] for words in map(ascii_lower_words, texts(batch.column(len(keep))))], dtype=np.uint64)
            found = found.reshape(-1, len(shingles)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.ascontiguousarray(c)) for c in found.T]], names=[*keep, *shingles])

    return source.mapInArrow(run, StructType([*source.schema.fields[:-1], *[StructField(n, LongType()) for n in shingles]]))


def variants(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, code) of the half-radius emission of unsigned fingerprints; ``origins`` inverts it.

    Code 0 is the fingerprint itself, 1 to 64 a flipped bit, 65 and more a pair of cleared bits.
    """
    both = (points[:, None] & _PAIRS) == _PAIRS
    owner, pair = np.nonzero(both)
    return (
        np.concatenate([points, (points[:, None] ^ _BITS).ravel(), points[owner] & ~_PAIRS[pair]]),
        np.concatenate([np.zeros(len(points), np.uint16), np.tile(np.arange(1, 65, dtype=np.uint16), len(points)), (65 + pair).astype(np.uint16)]),
    )


def origins(value: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The fingerprints that emitted variants: every code's change is undone by an exclusive or."""
    return value ^ _CHANGES[code]


def _emit(bits: int, step: int = 2000):
    """Blobs by bucket. A variant times an odd constant is a bijection whose top ``bits`` (8 or more) are the bucket; the low seven bytes and the code say the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(every), step):
                value, code = variants(every[start : start + step])
                mixed = value * _SPREAD
                order = np.argsort(mixed)
                mixed, code = mixed[order], code[order]
                bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                low = np.ascontiguousarray(mixed.view(np.uint8).reshape(-1, 8)[:, :7])
                parts = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges[:-1]]), pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([code[a:b].tobytes() for a, b in parts], pa.binary())],
                    names=["bucket", "low", "code"],
                )

    return run


def _meet(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Star links of one bucket."""
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), dtype=np.uint8).reshape(-1, 7)
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint16)
        whole = np.zeros((len(low), 8), dtype=np.uint8)
        whole[:, :7] = low
        mixed = whole.view(np.uint64).ravel()
        mixed &= np.uint64((1 << (64 - bits)) - 1)
        mixed |= np.uint64(table.column("bucket")[0].as_py() << (64 - bits))
        order = np.argsort(mixed)
        mixed, code = mixed[order], code[order]
        same = mixed[1:] == mixed[:-1]
        met = np.zeros(len(mixed), dtype=bool)
        met[1:] |= same
        met[:-1] |= same
        mixed, code = mixed[met], code[met]
        fp = origins(mixed * _GATHER, code)
        order = np.lexsort((fp, code > 64, mixed))
        mixed, code, fp = mixed[order], code[order], fp[order]
        first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]])) if len(mixed) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(mixed)))
        centre = np.repeat(fp[first], sizes)  # smallest fingerprint of level 0 or 1, if there is one
        light = np.repeat(code[first] <= 64, sizes)
        links = light & (fp != centre)
        a, b = centre[links], fp[links]
        if len(a):
            a, b = np.unique(np.stack([a, b], axis=1), axis=0).T
            near = np.bitwise_count(a ^ b) <= RADIUS
            a, b = a[near], b[near]
        return pa.table({"a": np.ascontiguousarray(a).view(np.int64), "b": np.ascontiguousarray(b).view(np.int64)})

    return run


def links(prints: DataFrame, name: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``prints``; every pair within three bits is connected by them."""
    distinct = cut(prints.select(prints[name].alias("fp")).where("fp is not null").distinct(), "fingerprints")
    count = distinct.count()
    bits = max(8, (count * 600 // BUCKET_VARIANTS).bit_length())
    # the written table may lie in few files; what is emitted is five hundred times its size
    emitted = distinct.repartition(max(1, -(-count // EMIT_PRINTS)), "fp").mapInArrow(_emit(bits), "bucket long, low binary, code binary")
    return cut(emitted.groupBy("bucket").applyInArrow(_meet(bits), "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node in reach.

    Alternating star contraction: large-star ties a node's larger neighbours to
    its smallest neighbour, small-star its smaller ones; both only regroup
    links, with map-side minima, and end when the links are stars. Each half of a
    round is a plan of its own: what a plan's stages hold on the driver grows
    with their number.
    """

    def either(first, second, names: tuple[str, str]):
        """Two rows of a row."""
        pair = [F.struct(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))) for columns in (first, second)]
        return F.explode(F.array(*pair)).alias("_pair")

    def stars(e: DataFrame) -> bool:
        """Whether every larger end has one link, and none where it is the smaller end."""
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(1).alias("up")))).alias("_end")).select("_end.*")
        odd = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
        return not odd.count()

    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        around = edges.select(either(("a", "b"), ("b", "a"), ("u", "v"))).select("_pair.*")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(around.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-stars")
        joined = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        edges = cut(joined.select(either(("m", "a"), ("m", "b"), ("a", "b"))).select("_pair.*").where("a <> b").distinct(), "stars")
        if stars(edges):
            break
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row; component_id is the smallest key in reach."""
    prints = cut(add_fingerprints(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), ["doc_id"], fp=shingle), "doc-fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fingerprint-classes")
    rooted = classes.join(components(links(classes)), classes["fp"] == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(rooted.join(named, "root").select("fp", "rows", "component_id"), "fingerprint-components")
    hot = F.col("rows") > max(HOT_ROWS, prints.count() // 1000)
    few, many = F.broadcast(by_print.where(hot).drop("rows")), by_print.where(~hot).drop("rows")
    met = prints.join(few, "fp").unionByName(prints.join(few, "fp", "left_anti").join(many, "fp"))
    return met.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicate_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", shingles: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(doc_id, component_id) of every non-null key, linked where any of several fingerprints is within three bits.

    Five-word shingles that agree by 0.8 differ in about ten bits, beyond the
    ball; over shorter shingles the same texts are nearer. The graph's nodes are
    distinct fingerprint tuples, named by their smallest key, so exact copies
    add neither nodes nor links.
    """
    names = [f"fp{k}" for k in shingles]
    source = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null")
    prints = cut(add_fingerprints(source, ["doc_id"], **dict(zip(names, shingles, strict=True))), "doc-fingerprints")
    nodes = cut(prints.groupBy(*names).agg(F.min("doc_id").alias("head")), "fingerprint-nodes")
    edges = None
    for name in names:
        tops = nodes.groupBy(name).agg(F.min("head").alias("top"))
        shared = nodes.join(tops, name).where("head <> top").select(F.col("top").alias("a"), F.col("head").alias("b"))
        left, right = (tops.select(F.col(name).alias(side), F.col("top").alias(f"{side}_top")) for side in ("a", "b"))
        pairs = links(nodes, name).join(left, "a").join(right, "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
        found = shared.unionAll(pairs)
        edges = found if edges is None else edges.unionAll(found)
    rooted = nodes.join(components(edges), F.col("head") == F.col("node"), "left").select(*names, F.coalesce("root", "head").alias("component_id"))
    return prints.join(rooted, names).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
