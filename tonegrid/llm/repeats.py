"""Removal of repeated passages (operator 12): count-min prefilter, then exact groups of what it leaves.

A window is ``window`` consecutive words of one document. Of all windows with the
same words the first one (by key, then by place) stays; the words that any later
one covers go. Windows are judged on the input, not on what is left of it.

1. ``pack``: documents are written once as blocks of about ``block_bytes`` of
   text (compressed, one row a block), in the order of their keys inside a block.
   A block is the unit that later steps send answers back to.
2. Sketch. Every block makes its own count-min sketch of ``DEPTH`` rows; counts
   stop at two, and only the cells that it touched are sent, as gaps between
   sorted cells (about two bytes a window and row). The width grows with the
   count of windows (at least ``CELLS_PER_WINDOW`` cells each). Parts are merged
   by ranges of ``2**range_bits`` cells, so a task holds one range, and each block
   gets one bit back for each of its cells: whether two windows met there. A
   count can only be too high, so no repeated window is lost; about 1 % of the
   single ones pass by chance.
3. Exact groups. Windows whose cells say "twice" in every row are named by 128
   bits of their words. A block sends each name once, with its first document
   there: later ones in the block are known to be late. So a window that a third
   of all documents hold is at most one entry a block. The smallest of all
   entries of a name is the first one; every other entry is sent back as late.
4. Blocks mark the words under late windows and leave them out.

Texts are shuffled once (steps 3 and 4 share the exchange of the blocks); neither
sketch nor names pass through the driver, which learns one number, the count of
windows. A lost executor costs a reread of blocks from the shared folder.

Cases: null and empty texts have no words and stay as empty texts; a text shorter
than the window keeps all; null keys come after all others; rows that repeat a
key are ordered by a hash of the text, and of equal rows one counts as the first;
an empty table gives no rows; other columns of the input are not looked at, and
the result has the key and its own columns only. A text is never split: one that
is longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partition_number, release, small_batches

WINDOW = 20
DEPTH = 2
CELLS_PER_WINDOW = 8
RANGE_BITS = 24
#: Windows for which one group of names is planned; those that pass the sketch are a part of them.
NAMES_PER_GROUP = 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROWS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


# --- blocks -----------------------------------------------------------------------------------------------------------


def _order(keys: pa.Array) -> np.ndarray:
    """Keys as unsigned numbers in the same order, null last."""
    plain = keys.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
    out = plain.view(np.uint64) ^ np.uint64(1 << 63)
    out[keys.is_null().to_numpy(zero_copy_only=False)] = np.uint64(2**64 - 1)
    return out


def _write(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20) -> DataFrame:
    """(block, windows, body): documents of a partition in blocks of about ``block_bytes`` of text, in the order of their keys."""
    small_batches(df.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = partition_number() << 32, [], 0

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            texts = rows["t"].to_pylist()
            order, hashed = _order(rows["k"].combine_chunks()), np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
            rows = rows.append_column("h", pa.array(hashed.view(np.int64))).take(pa.array(np.lexsort((hashed, order))))
            windows = sum(max(0, len(_split(t)) - window + 1) for t in texts)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([windows], pa.int64()), pa.array([_write(rows)], pa.binary())], ["block", "windows", "body"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            start = 0
            for i, n in enumerate(lengths):
                if size and size + n > block_bytes:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield close()
                    held, size, start, number = [], 0, i, number + 1
                size += n + 16
            if len(lengths) > start:
                held.append(batch.slice(start))
        if held:
            yield close()
        release()

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(blocks, "block long, windows long, body binary")


class _Block:
    """Words of a block's documents in one list, and the places where windows start."""

    def __init__(self, body: bytes, window: int):
        self.rows = _read(body)
        split = [_split(t) for t in self.rows["t"].to_pylist()]
        self.ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        self.words = [w for ws in split for w in ws]
        self.window = window

    def starts(self) -> np.ndarray:
        """Every place at which a whole window of one document starts."""
        begin = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else np.zeros(0, np.int64)
        at = np.arange(len(self.words), dtype=np.int64)
        room = np.repeat(self.ends, self.ends - begin) - at
        return at[room >= self.window]

    def cells(self, bits: int) -> list[np.ndarray]:
        """The cell of every window in each row of the sketch."""
        word = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))
        word = (word + np.uint64(1)) * _ODD
        word ^= word >> np.uint64(29)
        total = np.zeros(max(0, len(word) - self.window + 1), np.uint64)
        for j in range(self.window):
            total += word[j : j + len(total)] * np.uint64(pow(int(_ROWS[0]), j, 1 << 64))
        total = total[self.starts()]
        out = []
        for odd in _ROWS[:DEPTH]:
            x = (total ^ (total >> np.uint64(32))) * odd
            x = (x ^ (x >> np.uint64(29))) * _ODD
            out.append(x >> np.uint64(64 - bits))
        return out


# --- numbers as bytes -------------------------------------------------------------------------------------------------


def gaps(sorted_numbers: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them, seven bits a byte."""
    d = np.diff(sorted_numbers.astype(np.uint64), prepend=np.uint64(0))
    size = np.ones(len(d), np.int64)
    for k in range(1, 10):
        size += d >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[(ends - size)[more] + k] = ((d[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[more] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def ungaps(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of several lists in a row, and the count of each list."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    d = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        there = last - first >= k
        d[there] |= (raw[first[there] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    upto = np.searchsorted(last, np.cumsum([len(p) for p in parts]))
    counts = np.diff(upto, prepend=0)
    run = np.cumsum(d)
    before = np.where(upto - counts > 0, run[np.maximum(upto - counts, 1) - 1] if len(run) else 0, 0).astype(np.uint64)
    return run - np.repeat(before, counts), counts


# --- sketch -----------------------------------------------------------------------------------------------------------


def _touched(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells, and which of them hold two windows or more."""
    if not len(cells):
        return cells, np.zeros(0, bool)
    s = np.sort(cells)
    first = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.flatnonzero(first)
    return s[first], np.diff(np.append(at, len(s))) > 1


def _ranges(cells: np.ndarray, bits: int, range_bits: int) -> np.ndarray:
    """Where each range of cells begins and ends among sorted cells."""
    return np.searchsorted(cells, np.arange((1 << max(0, bits - range_bits)) + 1, dtype=np.uint64) << np.uint64(min(bits, range_bits)))


_PARTIAL = pa.schema([("row", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])


def _sketches(window: int, bits: int, range_bits: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for row, cells in enumerate(_Block(body.as_py(), window).cells(bits)):
                    own, twice = _touched(cells)
                    cuts = _ranges(own, bits, range_bits)
                    for r in np.flatnonzero(np.diff(cuts)):
                        part = own[cuts[r] : cuts[r + 1]] - (np.uint64(r) << np.uint64(range_bits))
                        out.append((row, int(r), number, gaps(part), np.packbits(twice[cuts[r] : cuts[r + 1]]).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL)
        release()

    return partial


_ANSWER = pa.schema([("row", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("twice", pa.binary())])


def _merge(bits: int, range_bits: int):
    def merged(part: pa.Table) -> pa.Table:
        """One range of one row of the sketch: the sum of all parts, and for each block which of its cells hold two or more."""
        cells, counts = ungaps(part["cells"].to_pylist())
        cells = cells.astype(np.int64)
        local = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(part["twice"].to_pylist(), counts, strict=True)])
        total = np.zeros(1 << min(bits, range_bits), bool)
        total[cells[local]] = True
        s = np.sort(cells)
        total[s[1:][s[1:] == s[:-1]]] = True
        say, upto = total[cells], np.cumsum(counts)
        answers = [np.packbits(say[end - n : end]).tobytes() for n, end in zip(counts, upto, strict=True)]
        return pa.table([part["row"], part["range"], part["block"], pa.array(answers, pa.binary())], schema=_ANSWER)

    return merged


# --- exact groups -----------------------------------------------------------------------------------------------------

_NAMED = pa.schema([("group", pa.int64()), ("block", pa.int64()), ("starts", pa.binary()), ("names", pa.binary()), ("order", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _candidates(window: int, bits: int, range_bits: int, groups: int):
    def name(left: pa.Table, right: pa.Table) -> pa.Table:
        """Names of a block's windows that the sketch calls repeated, each once; places of those that the block itself repeats."""
        out, number = [], left["block"][0].as_py() if left.num_rows else None
        answers = {(r, g): b for r, g, b in zip(right["row"].to_pylist(), right["range"].to_pylist(), right["twice"].to_pylist(), strict=True)}
        if number is not None and answers:
            block = _Block(left["body"][0].as_py(), window)
            at = block.starts()
            passed = np.ones(len(at), bool)
            for row, cells in enumerate(block.cells(bits)):
                own, _ = _touched(cells)
                cuts, say = _ranges(own, bits, range_bits), np.zeros(len(own), bool)
                for r in np.flatnonzero(np.diff(cuts)):
                    say[cuts[r] : cuts[r + 1]] = np.unpackbits(np.frombuffer(answers[row, int(r)], np.uint8), count=int(cuts[r + 1] - cuts[r]))
                left_over = np.flatnonzero(passed)
                passed[left_over] = say[np.searchsorted(own, cells[left_over])]
            at = at[passed]
            if len(at):
                words, digest = block.words, xxhash.xxh3_128_digest
                names = np.frombuffer(b"".join([digest(b" ".join(words[i : i + window])) for i in at.tolist()]), ">u8").astype(np.uint64).reshape(-1, 2)
                by = np.lexsort((names[:, 1], names[:, 0]))  # stable: places ascend inside a name
                new = np.concatenate([[True], (names[by][1:] != names[by][:-1]).any(axis=1)])
                again = np.sort(at[by[~new]])
                if len(again):
                    out.append((number % groups, number, gaps(again), b"", b"", b"", b""))
                one = np.sort(by[new])
                at, names = at[one], names[one]
                docs = np.searchsorted(block.ends, at, side="right")
                order, hashed = _order(block.rows["k"].combine_chunks()), block.rows["h"].to_numpy().view(np.uint64)
                group = (names[:, 0] % np.uint64(groups)).astype(np.int64)
                by = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1], [True]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows = by[a:b]
                    doc, per = np.unique(docs[rows], return_counts=True)
                    out.append((int(group[rows[0]]), number, gaps(at[rows]), names[rows].tobytes(), order[doc].tobytes(), hashed[doc].tobytes(), per.astype(np.int32).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NAMED, strict=True)], schema=_NAMED) if out else _NAMED.empty_table()

    return name


_LATE = pa.schema([("block", pa.int64()), ("starts", pa.binary())])


def _late(part: pa.Table) -> pa.Table:
    """Places of all windows of a group of names but the first of each name."""
    column = lambda c, kind: [np.frombuffer(b, kind) for b in part[c].to_pylist()]
    names, starts, blocks = column("names", np.uint64), part["starts"].to_pylist(), np.array(part["block"].to_pylist(), np.int64)
    per = column("counts", np.int32)
    sizes = np.array([len(n) // 2 for n in names])
    out = [(int(b), s) for b, s, n in zip(blocks, starts, sizes, strict=True) if not n]
    full = np.flatnonzero(sizes)
    if len(full):
        name = np.concatenate([names[i] for i in full]).reshape(-1, 2)
        order = np.concatenate([np.repeat(o, per[i]) for i, o in enumerate(column("order", np.uint64)) if sizes[i]])
        hashed = np.concatenate([np.repeat(o, per[i]) for i, o in enumerate(column("hashes", np.uint64)) if sizes[i]])
        place, _ = ungaps([starts[i] for i in full])
        row = np.repeat(full, sizes[full])
        by = np.lexsort((place, blocks[row], hashed, order, name[:, 1], name[:, 0]))
        later = by[1:][(name[by][1:] == name[by][:-1]).all(axis=1)]
        later = later[np.lexsort((place[later], row[later]))]
        for i in np.unique(row[later]):
            out.append((int(blocks[i]), gaps(place[later[row[later] == i]])))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LATE, strict=True)], schema=_LATE) if out else _LATE.empty_table()


def _without(window: int, schema: pa.Schema):
    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        block = _Block(left["body"][0].as_py(), window)
        n = len(block.words)
        edge = np.zeros(n + 1, np.int64)
        for b in right["starts"].to_pylist():
            at = ungaps([b])[0].astype(np.int64)
            edge[at] += 1  # places are distinct inside a list
            edge[at + window] -= 1
        stays = np.cumsum(edge[:n]) == 0
        texts, removed, begin = [], [], 0
        for end in block.ends.tolist():
            own = stays[begin:end]
            words = block.words[begin:end]
            texts.append(b" ".join(words if own.all() else [words[i] for i in np.flatnonzero(own)]))
            removed.append(int(len(own) - own.sum()))
            begin = end
        counts = np.diff(block.ends, prepend=0)
        arrays = [block.rows["k"].combine_chunks(), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        return pa.table([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return kept


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20, range_bits: int = RANGE_BITS, names_per_group: int = NAMES_PER_GROUP) -> DataFrame:
    """(key, text, n_words, n_removed): every document without the words that a later copy of a window covers.

    ``text`` is what is left, joined by single blanks.
    """
    blocks = cut(pack(df, key, text, window, block_bytes), "repeat-blocks")
    total = blocks.agg(F.sum("windows")).first()[0] or 0
    bits = max(10, math.ceil(math.log2(max(1, CELLS_PER_WINDOW * total))))
    groups = 1 + total // names_per_group
    bodies = blocks.select("block", "body")
    parts = bodies.mapInArrow(_sketches(window, bits, range_bits), "row int, range long, block long, cells binary, twice binary")
    answers = parts.groupBy("row", "range").applyInArrow(_merge(bits, range_bits), "row int, range long, block long, twice binary")
    named = bodies.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_candidates(window, bits, range_bits, groups), "group long, block long, starts binary, names binary, order binary, hashes binary, counts binary")
    late = named.groupBy("group").applyInArrow(_late, "block long, starts binary")
    out = pa.schema([(key, pa.int64()), (text, pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
    return bodies.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(_without(window, out), f"`{key}` long, `{text}` string, n_words long, n_removed long")


def plain(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """(key, n_words, n_removed, sha256 of what is left) by a dictionary of all windows, for tests."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, xxhash.xxh3_64_intdigest((rows[i][1] or "").encode()), i))
    seen, out = set(), []
    for i in order:
        words = _split(rows[i][1])
        gone = set()
        for s in range(len(words) - window + 1):
            name = tuple(words[s : s + window])
            if name in seen:
                gone.update(range(s, s + window))
            seen.add(name)
        left = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((rows[i][0], len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return out
