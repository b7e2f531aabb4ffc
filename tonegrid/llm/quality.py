"""Quality rules with cross-document line frequency (operator 9).

Per document: counts of words, symbols, repeated lines and repeated 3-word
windows, from which the base rules follow. Across documents: every line is
normalised (lower case, blanks to one space, trimmed) and hashed, and the
documents of a host that hold it are counted. A line in more than ``max_docs``
documents of its host is boilerplate and is removed; a document that keeps
fewer than ``min_words`` words or less than ``min_left_percent`` of its words is
depleted and rejected. The limit is a number of documents, so the same line with
the same count has the same fate in small and in large hosts.

Every row is a document. For the lines of a text itself, the text's exact copies
count as one document: a page that is mirrored twelve times is not boilerplate
(copies are for deduplication to judge), but for every other text each of the
twelve counts. ``count="texts"`` counts distinct texts instead.

Plan: one pass for the base counts; the lines are grouped by (host, text, line)
with map-side sums and meet the number of copies of their text, then they are
counted by (host, line), again with map-side sums. Lines above the limit are
spread over ``SALTS`` rows when they go back to the lines of all texts, so a line
that a third of all documents hold is not one task's. The verdict belongs to
(host, text) and joins back to the rows (copies of one text that are a third of
all rows are a skewed side, which adaptive execution splits). Texts and lines are known by 128
bits of hash.

Cases: null texts count as empty and fail the base rules; a null host is a host
of its own; texts without a word have no lines; very long texts are judged whole,
in time linear in their lines; repeated rows are documents and get the same
verdict; an empty table gives no rows; other columns are ignored by ``assess``
and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WORD_SPLIT, cut, parts, small_batches, texts

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Rows that a boilerplate line is spread over when it meets the texts again.
SALTS = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_docs: int = 10
    min_left_percent: int = 30
    count: str = "documents"  # or "texts"


def repeated_words(words: list[str], window: int = 3) -> int:
    """Words inside windows that occur twice or more."""
    if len(words) <= window:
        return 0
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    at = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
    if len(ids) == len(words):
        return 0
    n = len(words) - window + 1
    key = at[:n].copy()
    for k in range(1, window):
        key = key * len(ids) + at[k : k + n]
        if k + 1 < window:
            key = np.unique(key, return_inverse=True)[1]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[back] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[hit + k] = True
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = _WORD.findall(text)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            if line in seen:
                repeated += 1
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated, repeated_words(words)


def _body(docs: DataFrame, text: str):
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def normalised(line):
    return F.trim(F.regexp_replace(F.lower(line), WORD_SPLIT, " "))


def _hash(text):
    """128 bits of a text column: two hashes of different seeds."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("l"))


def _spread(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """(_host, _text, _removed, _lines) of the texts that hold boilerplate: its words, and the hashes of its lines."""
    if params.count not in ("documents", "texts"):
        raise ValueError("count must be 'documents' or 'texts'")
    body = _body(docs, text)
    facts = docs.select(docs[host].cast("string").alias("_host"), _hash(body).alias("_text"), body.alias("_body"))
    each = facts.select("_host", "_text", F.explode(F.split("_body", "\n")).alias("_raw")).select("_host", "_text", normalised(F.col("_raw")).alias("_norm")).where("_norm <> ''")
    # every copy of a text adds its words here; the number of copies divides them again
    summed = each.groupBy("_host", "_text", _hash(F.col("_norm")).alias("_line")).agg(F.sum(F.size(F.split("_norm", " "))).alias("_words"))
    copies = facts.groupBy("_host", "_text").agg(F.count("*").alias("_copies"))
    copies = copies.select(F.col("_host").alias("_h"), F.col("_text").alias("_t"), "_copies")
    both = summed.join(copies, summed["_host"].eqNullSafe(copies["_h"]) & (summed["_text"] == copies["_t"]))
    own = F.col("_copies") if params.count == "documents" else F.lit(1).cast("long")
    lines = cut(both.select("_host", "_text", "_line", F.expr("_words div _copies").alias("_words"), own.alias("_own")), "quality-lines")
    counted = lines.groupBy("_host", "_line").agg(F.sum("_own").alias("_n")).where(F.col("_n") > params.max_docs)
    above = counted.select(F.col("_host").alias("_h"), F.col("_line").alias("_l"), "_n", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("_part"))
    dealt = lines.withColumn("_salt", _spread("_text"))
    found = dealt.join(above, dealt["_host"].eqNullSafe(above["_h"]) & (dealt["_line"] == above["_l"]) & (dealt["_salt"] == above["_part"]))
    found = found.where(F.col("_n") - F.col("_own") + 1 > params.max_docs)
    return found.groupBy("_host", "_text").agg(F.sum("_words").alias("_removed"), F.collect_set("_line.h").alias("_lines"))


def _counter(at: int, kinds: StructType):
    """Arrow pass that appends the base counts of the texts in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, at):
            counted = [base_counts(t) for t in texts(batch.column(at))]
            columns = [pa.array([c[k] for c in counted], pa.int64()) for k in range(len(COUNTS))]
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*[f.name for f in kinds.fields[: len(kept)]], *COUNTS])

    return run


def assess(docs: DataFrame, params: QualityParams = QualityParams(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts, ``base_failed``, ``left_words`` and ``kept`` of every row of ``docs``."""
    small_batches(docs.sparkSession)
    body = _body(docs, text)
    source = docs.select(docs[key].alias("doc_id"), docs[host].cast("string").alias("host"), _hash(body).alias("text_hash"), body.alias("body"))
    kinds = StructType([*source.schema.fields[:3], *(StructField(c, LongType()) for c in COUNTS)])
    counted = source.mapInArrow(_counter(3, kinds), kinds)
    removed = boilerplate(docs, host, text, params).select("_host", "_text", "_removed")
    joined = counted.join(removed, counted["host"].eqNullSafe(removed["_host"]) & (counted["text_hash"] == removed["_text"]), "left")
    left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    depleted = (left < params.min_words) | (100 * left < params.min_left_percent * F.col("n_words"))
    return joined.select("doc_id", "host", "text_hash", *COUNTS, left.alias("left_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def clean(docs: DataFrame, params: QualityParams = QualityParams(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, boilerplate lines removed from their texts; the columns stay.

    Rows meet the removed lines of their (host, text), then one Arrow pass
    judges and strips them; the hashes of a text's lines go along only where it
    holds boilerplate.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text)
    body = _body(docs, text)
    rows = docs.select(*[(docs[c].cast("string") if k == at else docs[c]).alias(f"c{k}") for k, c in enumerate(names)], docs[host].cast("string").alias("_row_host"), _hash(body).alias("_row_text"))
    removed = boilerplate(docs, host, text, params)
    joined = rows.join(removed, rows["_row_host"].eqNullSafe(removed["_host"]) & (rows["_row_text"] == removed["_text"]), "left")
    lines = F.split(F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")), "\n")
    hashes = F.when(F.col("_lines").isNotNull(), F.transform(lines, lambda x: F.xxhash64(normalised(x))))
    flagged = joined.select(*[f"c{k}" for k in range(len(names))], F.coalesce("_removed", F.lit(0)).cast("long").alias("_removed"), "_lines", hashes.alias("_hashes"))
    width = len(names)

    def stripped(body: str, gone, hashes) -> str:
        gone = set(gone)
        return "\n".join(line for line, h in zip(body.split("\n"), hashes, strict=True) if h not in gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, at):
            said, keep = texts(batch.column(at)), []
            for t, less in zip(said, batch.column(width).to_pylist(), strict=True):
                n, _, _, _, repeated = base_counts(t)
                left = n - less
                keep.append(n >= params.min_words and 100 * repeated <= params.max_repeat_percent * n and left >= params.min_words and 100 * left >= params.min_left_percent * n)
            kept = pa.array(keep, pa.bool_())
            out = batch.filter(kept)
            new = [t if gone is None else stripped(t, gone, hashes) for t, gone, hashes in zip(texts(out.column(at)), out.column(width + 1).to_pylist(), out.column(width + 2).to_pylist(), strict=True)]
            columns = [pa.array(new, pa.string()) if k == at else out.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    kinds = StructType([StructField(f"c{k}", StringType() if k == at else f.dataType) for k, f in enumerate(docs.schema.fields)])
    return flagged.mapInArrow(run, kinds).toDF(*names)
