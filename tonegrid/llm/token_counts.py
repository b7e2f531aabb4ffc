"""Token counts without token ids (operator 1).

A document's count is the sum over its distinct pre-tokens of frequency times
pieces per pre-token. Every distinct pre-token of the corpus is encoded once;
no id list of a document ever exists.

Plan
    1. One pass over the texts packs up to ``BLOCK_DOCS`` documents into a
       *block*: a compressed matrix of (word of the block, document slot,
       frequency), and one small row (pre-token, block, word number) for every
       distinct pre-token of the block.
    2. The rows are dealt by pre-token, so all rows of one meet in one task,
       which encodes it once. Only pre-tokens of more than one piece answer
       (block, word number, extra pieces); the others are in the base count.
    3. Answers and matrices meet by block, where frequencies times pieces are
       summed per document.

Blocks bound every group: a word in a third of all documents has one row a
block, and a block has at most ``BLOCK_DOCS`` documents.

Input that comes out of a shuffle is written first, so that a lost executor's
tasks see its rows in the same order and number words as before.

Cases: a null text counts as empty (0 bytes, 0 tokens); empty texts have 0
tokens; very long texts are counted whole, a block of their own if need be;
repeated rows are counted row by row; a null key stays null; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, once, partition_number, parts, release, small_batches, texts, tokenizer_path

BLOCK_DOCS = 4096
BLOCK_CHARS = 1 << 23
OVER_LIMIT = 2048
#: Pre-tokens whose pieces a task remembers.
_HELD_WORDS = 300_000

_ROWS = "key string, block long, word int, body binary"
#: Below this point letters and digits have had their classes since early Unicode, and every text is its own NFC.
_STABLE = re.compile("[^\x00-\u024f]")
_KIND = {k: re.escape("".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == k)) for k in "LN"}
#: The split pattern of word_bpe_49k.json, its classes written out for the range above.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_KIND['L']}]+|[{_KIND['N']}]|[^\\t-\\r \x85\xa0{_KIND['L']}{_KIND['N']}]+")


@once
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and every thread keeps memory of its own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special_pattern(path: str):
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"] if t["special"]]
    return re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None


#: What word_bpe_49k.json does before its model; ``_SPLIT`` stands for both parts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@once
def _words_alone(path: str) -> bool:
    """Whether pre-tokens of this vocabulary file are words of the text, which ``_SPLIT`` finds and ``encode`` takes as they are."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    return whole["normalizer"] == _NORMALIZER and whole["pre_tokenizer"] == _PRE_TOKENIZER


def pretokens(text: str, path: str) -> list[str]:
    """Pre-tokens of a text without special strings, in order: as characters where ``_words_alone``, else as the model's own symbols."""
    alone = _words_alone(path)
    if alone and _STABLE.search(text) is None:
        return _SPLIT.findall(text.lower())
    tokenizer = _tokenizer(path)
    clean = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
    if tokenizer.pre_tokenizer is None:
        return [clean] if clean else []
    found = tokenizer.pre_tokenizer.pre_tokenize_str(clean)
    return [clean[a:b] for _, (a, b) in found] if alone else [symbols for symbols, _ in found]


def _pieces(words: list[str], path: str) -> list[int]:
    """Pieces of every pre-token."""
    tokenizer = _tokenizer(path)
    if _words_alone(path):
        return [len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    return [len(tokenizer.model.tokenize(w)) for w in words]


def _bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed value; ``_arrays`` reads it."""
    head = np.array([[len(a), a.dtype.itemsize] for a in arrays], dtype=np.int64)
    return zstandard.compress(b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *(a.tobytes() for a in arrays)]), 3)


def _arrays(body: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for length, width in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2):
        out.append(np.frombuffer(raw, f"<i{width}" if width == 8 else f"<u{width}", length, at))
        at += int(length * width)
    return out


class _Block:
    """Documents gathered so far, and the words they hold."""

    def __init__(self):
        self.keys, self.sizes, self.base, self.ids, self.chars = [], [], [], [], 0
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, key, text: str, found: list[str], n_special: int) -> None:
        self.ids.append(np.fromiter(map(self.words.__getitem__, found), dtype=np.int32, count=len(found)))
        self.keys.append(key)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.base.append(len(found) + n_special)
        self.chars += len(text)

    def rows(self, block: int) -> pa.RecordBatch:
        pairs = np.concatenate(self.ids).astype(np.int64)
        pairs <<= 16
        pairs |= np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        self.ids = []
        pairs.sort()
        edges = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edges, len(pairs)))
        pairs = pairs[edges]
        n = len(self.words)
        width = np.uint8 if not len(counts) or counts.max() < 256 else np.uint32
        known = np.array([k is not None for k in self.keys], dtype=np.int64)
        whole = [np.array([k or 0 for k in self.keys], dtype=np.int64), known, np.array(self.sizes, dtype=np.int64), np.array(self.base, dtype=np.int64)]
        body = _bytes([*whole, np.bincount(pairs >> 16, minlength=n).astype(np.uint32), (pairs & 0xFFFF).astype(np.uint16), counts.astype(width)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*self.words, f" {block}"], pa.string()),
                pa.array(np.full(n + 1, block)),
                pa.array(np.append(np.arange(n, dtype=np.int32), np.int32(-1))),
                pa.array([*[None] * n, body], pa.binary()),
            ],
            names=["key", "block", "word", "body"],
        )


def _rows(batches: Iterator[pa.RecordBatch]):
    for part in parts(batches, 1, max_rows=256):
        yield from zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True)


def _pack(path: str):
    special = _special_pattern(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = partition_number() << 24
        block, number = _Block(), 0
        for key, text in _rows(batches):
            parts = special.split(text) if special else [text]
            found = pretokens(parts[0], path)
            for part in parts[1:]:
                found += pretokens(part, path)
            block.add(key, text, found, len(parts) - 1)
            if len(block.keys) >= BLOCK_DOCS or block.chars >= BLOCK_CHARS:
                yield block.rows(first | number)
                block, number = _Block(), number + 1
                pa.default_memory_pool().release_unused()
        if block.keys:
            yield block.rows(first | number)

    return run


def _answer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            is_word = pc.greater_equal(batch.column(2), 0)
            rest, words = batch.filter(pc.invert(is_word)), batch.filter(is_word)
            coded = words.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(held) > _HELD_WORDS:
                held.clear()
            fresh = [w for w in distinct if w not in held]
            held.update(zip(fresh, _pieces(fresh, path), strict=True))
            extra = np.array([held[w] for w in distinct], dtype=np.int64)[coded.indices.to_numpy()] - 1 if len(words) else np.zeros(0, np.int64)
            told = pa.RecordBatch.from_arrays([words.column(1), words.column(2), pa.array(extra), words.column(3)], names=_ANSWER)
            yield told.filter(pa.array(extra > 0))
            if len(rest):
                yield pa.RecordBatch.from_arrays([rest.column(1), rest.column(2), pa.array(np.zeros(len(rest), np.int64)), rest.column(3)], names=_ANSWER)
        held.clear()
        release()

    return run


_ANSWER = ["block", "word", "extra", "body"]


def _sum_block(table: pa.Table) -> pa.Table:
    word = table.column("word").to_numpy()
    body = next(b for b in table.column("body").to_pylist() if b is not None)
    keys, known, sizes, base, lengths, slots, counts = _arrays(body)
    extra = np.zeros(len(lengths), dtype=np.float64)
    extra[word[word >= 0]] = table.column("extra").to_numpy()[word >= 0]
    more = np.bincount(slots, weights=np.repeat(extra, lengths) * counts, minlength=len(keys))
    return pa.table({"doc_id": pa.array(keys, mask=known == 0), "n_bytes": sizes, "n_tokens": base + more.astype(np.int64)})


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text", over: int = OVER_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``tokenizer`` names a ``tokenizers`` file; counts equal
    ``len(encode(text, add_special_tokens=False))``, special strings inside
    texts being one token each as the library has it.
    """
    path = tokenizer_path(tokenizer)
    small_batches(docs.sparkSession)
    source = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    if "Exchange" in source._jdf.queryExecution().executedPlan().toString():
        source = cut(source, "texts-to-count")  # blocks are numbered in the order of rows, which a recomputed shuffle does not keep
    answers = source.mapInArrow(_pack(path), _ROWS).repartition("key").mapInArrow(_answer(path), "block long, word int, extra long, body binary")
    sums = answers.groupBy("block").applyInArrow(_sum_block, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > over)
