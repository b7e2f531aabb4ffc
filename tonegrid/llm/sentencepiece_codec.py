"""SentencePiece encoding and decoding (operator 2).

Short texts go to the sentencepiece library as they are. A giant text is split
into chunks and encoded by a max-plus parallel scan:

* Cuts lie every ``chunk_chars`` characters of the normalised text. The state at
  a cut is the piece [a, b) that covers the character before it.
* A chunk yields a transfer matrix between the states of its two cuts, with 0
  for a feasible pair and minus infinity otherwise. Piece sequences are scored
  by adjacency: a pair of pieces is feasible if encoding the two surfaces
  together gives the pair. A greedy best-first merge encoder (BPE) yields the
  one sequence whose adjacent pairs are all feasible, so the max-plus product
  of the matrices has exactly one best path, and it is the library's encoding
  of the whole text.
* Matrices combine associatively; a scan over a text's chunks fixes the state
  at every cut, and every chunk is then backtraced on its own.

A chunk's matrix takes one encoding of the chunk: encodings that start at other
candidate states, or end at other ones, run into it after a few pieces, and from
a shared piece on they follow it. Where they do not, the whole span is encoded.

Plan: short texts are one narrow pass. Distinct giant texts become chunk rows,
dealt evenly; matrices (a few bytes a chunk) meet per text, states return to
the chunks, and piece ids meet per text at the end.

Cases: null texts count as empty and have no ids; the marker U+2581 in a text
reads back as a blank, as the library has it (``round_trip`` compares with that);
repeated rows are encoded row by row, giant ones once per distinct text; other
columns are kept by ``encode``, but for one named ``ids``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import once, parts, small_batches, texts, tokenizer_path

CHUNK_CHARS = 16_384
GIANT_CHUNKS = 2
MARK = "▁"


class Codec:
    """The library's model; and, made when a giant text needs them, the model without the leading marker and piece lengths."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)

    @cached_property
    def proto(self):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(self.path, "rb") as f:
            model.ParseFromString(f.read())
        return model

    @cached_property
    def splittable(self) -> bool:
        spec, trainer = self.proto.normalizer_spec, self.proto.trainer_spec
        return trainer.model_type == type(trainer).BPE and spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces

    @cached_property
    def part(self):
        import sentencepiece

        model = type(self.proto)()
        model.CopyFrom(self.proto)
        model.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    @cached_property
    def lengths(self) -> np.ndarray:
        """Characters of every piece: a byte piece that leads a character stands for it, continuation bytes have length 0."""
        byte = type(self.proto).SentencePiece.BYTE
        return np.array([(0 if 0x80 <= int(p.piece[3:5], 16) < 0xC0 else 1) if p.type == byte else len(p.piece) for p in self.proto.pieces], dtype=np.int64)

    @cached_property
    def longest(self) -> int:
        byte = type(self.proto).SentencePiece.BYTE
        return int(max(len(p.piece) for p in self.proto.pieces if p.type != byte))

    def pieces(self, marked: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of normalised characters; bytes of one character share its span."""
        ids = np.array(self.part.encode(marked), dtype=np.int32)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        tail = self.lengths[ids] == 0
        starts[tail] = ends[tail] - 1
        return ids, starts, ends


@once
def _codec(path: str) -> Codec:
    return Codec(path)


def marked(text: str) -> str:
    """The model's normal form (identity normaliser): a leading marker, blanks as markers."""
    return MARK + text.replace(" ", MARK) if text else ""


class Chunk:
    """One span [low, high) of a normalised text, with the context its states reach into.

    ``text`` starts at character ``low - reach`` (or 0) and ends ``reach`` after ``high`` (or at the end).
    """

    def __init__(self, codec: Codec, text: str, low: int, high: int, first: bool, last: bool):
        self.codec, self.text, self.first, self.last = codec, text, first, last
        self.offset = max(0, low - codec.longest)
        self.low, self.high = low, high
        self.starts = [0] if first else list(range(max(0, low - codec.longest), low))
        end = self.offset + len(text)
        self.ends = [end] if last else list(range(high, min(end, high + codec.longest - 1) + 1))
        self.main = self._encode(self.starts[0], self.ends[-1])
        self._heads: dict = {}
        self._tails: dict = {}

    def _encode(self, a: int, b: int):
        ids, s, e = self.codec.pieces(self.text[a - self.offset : b - self.offset])
        return ids, s + a, e + a

    def _sync(self, one, spans: dict, order) -> tuple[int, int] | None:
        for k in order:
            if k and one[1][k] == one[1][k - 1]:
                continue  # a later byte of one character
            j = spans.get((int(one[1][k]), int(one[2][k])))
            if j is not None:
                return k, j
        return None

    def _head(self, a: int):
        """Pieces from state start ``a`` up to where they join the main encoding: (own pieces, index in main)."""
        if a not in self._heads:
            spans = self._spans()
            width, found = 8 * self.codec.longest, None
            while found is None:
                stop = min(a + width, self.ends[-1])
                own = self._encode(a, stop)
                sure = len(own[0]) if stop == self.ends[-1] else int(np.searchsorted(own[1], own[1][-1]))
                at = self._sync(own, spans, range(sure))
                found = (own, *at) if at else (None if stop < self.ends[-1] else (own, -1, -1))
                width *= 4
            self._heads[a] = found
        return self._heads[a]

    def _tail(self, d: int):
        if d not in self._tails:
            spans = self._spans()
            width, found = 8 * self.codec.longest, None
            while found is None:
                start = max(d - width, self.starts[0])
                own = self._encode(start, d)
                at = self._sync(own, spans, range(len(own[0]) - 1, 0 if start > self.starts[0] else -1, -1))
                found = (own, *at) if at else (None if start > self.starts[0] else (own, -1, -1))
                width *= 4
            self._tails[d] = found
        return self._tails[d]

    def _spans(self) -> dict:
        if not hasattr(self, "_by_span"):
            self._by_span = {}
            for k, (s, e) in enumerate(zip(self.main[1].tolist(), self.main[2].tolist(), strict=True)):
                self._by_span.setdefault((s, e), k)
        return self._by_span

    def path(self, a: int, d: int):
        """The feasible sequence over [a, d): (ids, starts, ends)."""
        head, hk, hj = self._head(a)
        tail, tk, tj = self._tail(d)
        if hj < 0 or tj < 0 or hj > tj:
            return self._encode(a, d)
        return tuple(np.concatenate([h[:hk], m[hj:tj], t[tk:]]) for h, m, t in zip(head, self.main, tail, strict=True))

    def ends_of(self, a: int, d: int) -> tuple[int, int]:
        """(end of the first piece, start of the last) without building the whole path where it joins the main one."""
        head, hk, hj = self._head(a)
        tail, tk, tj = self._tail(d)
        if hj < 0 or tj < 0 or hj > tj:
            _, s, e = self._encode(a, d)
            return int(e[0]), int(s[-1])
        first = head[2][0] if hk else (self.main[2][hj] if hj < tj else tail[2][tk])
        last = tail[1][-1]
        return int(first), int(last)

    def matrix(self) -> list[tuple[int, int, int, int]]:
        """Feasible entries (a, b, c, d): in-state [a, b), out-state [c, d)."""
        out = []
        for a in self.starts:
            for d in self.ends:
                if d <= a:
                    continue
                b, c = self.ends_of(a, d)
                if (self.first or b >= self.low) and (self.last or c < self.high):
                    out.append((0 if self.first else a, 0 if self.first else b, c, d))
        return out

    def backtrace(self, a: int, d: int) -> np.ndarray:
        """Piece ids of the chunk; the piece that covers its lower cut belongs to the chunk before."""
        ids, starts, _ = self.path(a, d)
        return ids if self.first else ids[starts > starts[0]]


def compose(left: dict, right: dict) -> dict:
    """Max-plus product of sparse matrices {in: {out: weight}}."""
    out: dict = {}
    for i, row in left.items():
        best: dict = {}
        for j, w in row.items():
            for k, v in right.get(j, {}).items():
                if k not in best or w + v > best[k]:
                    best[k] = w + v
        if best:
            out[i] = best
    return out


def scan(matrices: list[dict]) -> list[dict]:
    """Inclusive prefix products by halving: pairs are combined, scanned, and spread back."""
    if len(matrices) <= 1:
        return list(matrices)
    pairs = scan([compose(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else compose(pairs[k // 2 - 1], matrices[k]))
    return out


def states(entries: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """(a, d) of every chunk: start of its in-state and end of its out-state on the one feasible path."""
    matrices: list[dict] = []
    for chunk in entries:
        m: dict = {}
        for a, b, c, d in chunk:
            m.setdefault((a, b), {})[(c, d)] = 0.0
        matrices.append(m)
    prefixes = scan(matrices)
    at = max(prefixes[-1][(0, 0)], key=prefixes[-1][(0, 0)].get)
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        before = prefixes[k - 1][(0, 0)] if k else {(0, 0): 0.0}
        came = max((s for s in before if at in matrices[k].get(s, {})), key=lambda s: before[s])
        out.append((came[0], at[1]))
        at = came
    return out[::-1]


def split(text: str, chunk_chars: int, reach: int) -> list[tuple[int, int, int, str]]:
    """(number, low, high, text with context) of the chunks of a normalised text."""
    n = len(text)
    count = max(1, n // chunk_chars)
    cuts = [n * k // count for k in range(count + 1)]
    return [(k, cuts[k], cuts[k + 1], text[max(0, cuts[k] - reach) : cuts[k + 1] + reach]) for k in range(count)]


def encode_giant(codec: Codec, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    """The scan on one machine, as the plan below runs it."""
    spans = split(marked(text), chunk_chars, codec.longest)
    chunks = [Chunk(codec, body, low, high, k == 0, k == len(spans) - 1) for k, low, high, body in spans]
    where = states([c.matrix() for c in chunks])
    return [int(x) for c, (a, d) in zip(chunks, where, strict=True) for x in c.backtrace(a, d)]


def _ids(lists) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def _short(path: str, at: int, chunk: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in parts(batches, at, 1 << 20, chunk):
            found = codec.whole.encode(texts(batch.column(at)), num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, _ids(found)], names=[*batch.schema.names, "ids"])

    return run


def _split(path: str, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = split(marked(text), chunk_chars, codec.longest)
                for k, low, high, body in parts:
                    yield pa.RecordBatch.from_pylist([{"giant": key, "k": k, "n": len(parts), "low": low, "high": high, "body": body}], schema=_CHUNK_ARROW)

    return run


_CHUNK_ARROW = pa.schema([("giant", pa.string()), ("k", pa.int32()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("body", pa.string())])
_CHUNK = "giant string, k int, n int, low long, high long, body string"


def _chunks(batch: pa.RecordBatch, codec: Codec):
    for r in batch.to_pylist():
        yield r, Chunk(codec, r["body"], r["low"], r["high"], r["k"] == 0, r["k"] == r["n"] - 1)


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = [{"giant": r["giant"], "k": r["k"], "entries": np.array(c.matrix(), dtype=np.int64).tobytes()} for r, c in _chunks(batch, codec)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("giant", pa.string()), ("k", pa.int32()), ("entries", pa.binary())]))

    return run


def _combine(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    where = states([np.frombuffer(r["entries"], dtype=np.int64).reshape(-1, 4).tolist() for r in rows])
    return pa.table({"giant": [r["giant"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "a": [int(a) for a, _ in where], "d": [int(d) for _, d in where]})


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            found = [(r["giant"], r["k"], c.backtrace(r["a"], r["d"])) for r, c in _chunks(batch, codec)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in found], pa.string()), pa.array([k for _, k, _ in found], pa.int32()), _ids([x for _, _, x in found])], names=["giant", "k", "ids"])

    return run


def _giant_ids(giants: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """(giant, all_ids) of distinct giant texts (giant, text)."""
    chunks = giants.mapInArrow(_split(path, chunk_chars), _CHUNK).repartition("giant", "k")
    matrices = chunks.mapInArrow(_matrices(path), "giant string, k int, entries binary")
    cut_states = matrices.groupBy("giant").applyInArrow(_combine, "giant string, k int, a long, d long")
    placed = chunks.join(cut_states, ["giant", "k"]).select("giant", "k", "n", "low", "high", "body", "a", "d")
    traced = placed.mapInArrow(_backtrace(path), "giant string, k int, ids array<int>")
    return traced.groupBy("giant").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("giant", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("all_ids"))


def _divided(docs: DataFrame, path: str, text: str, chunk_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """(short rows, giant rows with their ids as ``ids``); no giant rows where the model cannot be split."""
    if not Codec(path).splittable:
        return docs, None
    body = docs[text].cast("string")
    is_giant = F.coalesce(F.char_length(body), F.lit(0)) >= GIANT_CHUNKS * chunk_chars
    keyed = docs.where(is_giant).withColumn("__giant_key", F.md5(body.cast("binary")))
    distinct = keyed.select(F.col("__giant_key").alias("giant"), body.alias("text")).groupBy("giant").agg(F.first("text").alias("text"))
    found = _giant_ids(distinct, path, chunk_chars)
    return docs.where(~is_giant), keyed.join(found, keyed["__giant_key"] == found["giant"]).select(*[keyed[c] for c in docs.columns], F.col("all_ids").alias("ids"))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) added, equal to the library's ``encode``."""
    path = tokenizer_path(model)
    small_batches(docs.sparkSession)
    docs = docs.drop("ids")
    short, giant = _divided(docs, path, text, chunk_chars)
    done = short.mapInArrow(_short(path, docs.columns.index(text)), StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))
    return done if giant is None else done.unionAll(giant)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text added; null ids decode to null."""
    path = tokenizer_path(model)
    encoded = encoded.drop(name)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            found = [None if x is None else codec.whole.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    from pyspark.sql.types import StringType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(name, StringType())]))


def encode_and_check(docs: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, rows_at_once: int = 128) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids decode to the text they came from. Short texts are encoded and decoded in one pass."""
    path = tokenizer_path(model)
    small_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in parts(batches, 1, 1 << 20, rows_at_once):
            said = texts(batch.column(1))
            ids = batch.column(2).to_pylist() if batch.num_columns > 2 else codec.whole.encode(said, num_threads=1)
            back = codec.whole.decode(ids, num_threads=1)
            same = [a == b.replace(MARK, " ") for a, b in zip(back, said, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), _ids(ids), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    out = StructType([rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    short, giant = _divided(rows, path, "text", chunk_chars)
    done = short.mapInArrow(checked, out)
    return done if giant is None else done.unionAll(giant.mapInArrow(checked, out))
