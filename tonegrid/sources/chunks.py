"""Recordings in chunks with halos (SRC2, SRC4, CTX2; FRM1, FRM3, FRM5, FRM9 over chunks).

A recording of any length is a number of rows: chunk c owns the samples
``[start, start + core)`` and also carries samples before (``lead``) and behind
them, so that every frame and every context that it owns is whole. Frames belong
to the chunk that owns their centre, contexts to the chunk in which they start:
each is computed once, from one row, without a shuffle, and equals what the whole
clip would give.

Chunks come from WAV files by byte range (``wav_chunks``, a data source: tasks
read a header and their own range, nothing is listed but names and sizes), from
tables of samples (``chunk_samples``) or of runs of equal samples (``chunk_runs``), or
from clips in rows (``chunk_clips``).
A row holds at most ``MAX_BYTES`` of samples.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InputError
from ..operators.grid import KEY
from .audio import pcm_to_float, resample_range

MAX_BYTES = 64 << 20
SCHEMA = f"{KEY} string, sr int, n_samples long, chunk int, start long, lead int, core int, samples array<float>"
_ARROW = pa.schema([(KEY, pa.string()), ("sr", pa.int32()), ("n_samples", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()), ("lead", pa.int32()), ("core", pa.int32()), ("samples", pa.list_(pa.float32()))])


def _checked(core: int, halo: int) -> None:
    if core <= 0 or halo < 0:
        raise InputError("chunks need samples of their own")
    if 4 * (core + 2 * halo) > MAX_BYTES:
        raise InputError(f"a chunk of {core} samples and halos of {halo} is over {MAX_BYTES} bytes")


# --- WAV files by byte range ------------------------------------------------------------------------------------------


class WavHeader:
    """Where a WAV file's samples lie: plain, extensible and 64-bit RIFF headers."""

    def __init__(self, head: bytes, size: int):
        if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
            raise InputError("no WAV header")
        at, long_size = 12, None
        self.rate = self.channels = self.width = 0
        while at + 8 <= len(head):
            name, length = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
            if name == b"ds64":
                long_size = struct.unpack("<Q", head[at + 16 : at + 24])[0]
            elif name == b"fmt ":
                kind, self.channels, self.rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
                if kind == 0xFFFE:
                    kind = struct.unpack("<H", head[at + 32 : at + 34])[0]
                if kind != 1 or bits not in (8, 16, 24, 32) or not self.channels or not self.rate:
                    raise InputError("only PCM of 8, 16, 24 or 32 bits is read")
                self.width = bits // 8
            elif name == b"data":
                self.offset = at + 8
                length = long_size if long_size is not None and length == 0xFFFFFFFF else length
                length = min(length, size - self.offset)
                break
            at += 8 + length + length % 2
        else:
            raise InputError("no samples near the start of the file")
        if not self.width:
            raise InputError("no format before the samples")
        self.frame = self.width * self.channels
        self.n = length // self.frame


class _Range(InputPartition):
    def __init__(self, path: str, size: int, begin: int, end: int):
        super().__init__(path)
        self.path, self.size, self.begin, self.end = path, size, begin, end


class _WavReader(DataSourceReader):
    HEAD = 1 << 16

    def __init__(self, options: dict):
        self.path, self.sr = options.get("path"), int(options.get("sr", 22_050))
        if not self.path:
            raise InputError("wav_chunks needs a path")
        self.step = int(options.get("step", 512))
        up = lambda seconds: -(-int(float(seconds) * self.sr) // self.step) * self.step
        self.core, self.halo = up(options.get("seconds", 60)), up(options.get("halo", 2))
        _checked(self.core, self.halo)
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", MAX_BYTES)))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        top = files.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise InputError(f"no such file: {self.path}")
        found = [top] if top.is_file else [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.lower().endswith(".wav")]
        return [_Range(i.path, i.size, b, min(i.size, b + self.range_bytes)) for i in sorted(found, key=lambda i: i.path) for b in range(0, max(1, i.size), self.range_bytes)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with files.open_input_file(part.path) as f:
            try:
                head = WavHeader(f.read_at(min(self.HEAD, part.size), 0), part.size)
            except InputError as e:
                raise InputError(f"{part.path}: {e}") from None
            n = head.n if head.rate == self.sr else int(np.ceil(head.n * self.sr / head.rate))
            name = part.path.rsplit("/", 1)[-1]
            source = lambda i: i * head.rate // self.sr
            for chunk in range(-(-n // self.core) or 1):
                start = chunk * self.core
                place = head.offset + source(start) * head.frame
                if not (part.begin <= place < part.end or (start == 0 and part.begin == 0)):
                    continue
                lead, end = min(start, self.halo), min(n, start + self.core + self.halo)
                low, high = max(0, source(start - lead) - head.rate // 100 - 4096), min(head.n, source(end) + head.rate // 100 + 4096)
                raw = f.read_at((high - low) * head.frame, head.offset + low * head.frame)
                y = resample_range(pcm_to_float(raw, head.width, head.channels), low, head.n, head.rate, self.sr, start - lead, end)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([name.rsplit(".", 1)[0], self.sr, n, chunk, start, lead, min(self.core, n - start), y], _ARROW.types, strict=True)], schema=_ARROW)


class WavChunks(DataSource):
    """``spark.read.format("wav_chunks")``: ``path``, ``sr``, ``seconds`` of a chunk, ``halo`` in seconds, ``rangeBytes`` of a task."""

    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(dict(self.options))


def read_chunks(spark: SparkSession, path: str, sr: int = 22_050, seconds: float = 60.0, halo: float = 2.0, **options) -> DataFrame:
    """Chunks of all WAV files under ``path`` (any file system that Arrow opens), resampled and mixed to mono."""
    spark.dataSource.register(WavChunks)
    return spark.read.format("wav_chunks").options(sr=str(sr), seconds=str(seconds), halo=str(halo), **{k: str(v) for k, v in options.items()}).load(path)


# --- tables -----------------------------------------------------------------------------------------------------------


def chunk_samples(samples: DataFrame, position: str, value: str, sr: int, core: int, halo: int, key: str = KEY) -> DataFrame:
    """Chunks of signals that are tables of (key, position, value), positions from 0 without gaps.

    A sample goes to its own chunk and to those whose halo reaches it; a group is
    one chunk, so its size is bounded.
    """
    _checked(core, halo)
    i = F.col(position)
    reached = F.sequence(F.greatest(F.floor((i - halo) / core), F.lit(0)).cast("int"), F.floor((i + halo) / core).cast("int"))
    copied = samples.select(F.col(key).alias(KEY), i.cast("long").alias("_i"), F.col(value).cast("float").alias("_x"), F.explode(reached).alias("chunk"))
    start = F.col("chunk").cast("long") * core
    parts = copied.groupBy(KEY, "chunk").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
    sizes = samples.groupBy(F.col(key).alias("_key")).agg((F.max(i) + 1).cast("long").alias("n_samples"))
    sized = parts.join(sizes, parts[KEY].eqNullSafe(sizes["_key"])).where(start < F.col("n_samples"))
    return sized.select(
        KEY, F.lit(sr).alias("sr"), "n_samples", "chunk", start.alias("start"), (start - F.col("_s")[0]["_i"]).cast("int").alias("lead"),
        F.least(F.lit(core), F.col("n_samples") - start).cast("int").alias("core"), F.transform("_s", lambda s: s["_x"]).alias("samples"),
    )


def chunk_runs(runs: DataFrame, position: str, value: str, each: int, sr: int, core: int, halo: int, key: str = KEY) -> DataFrame:
    """``chunk_samples`` of signals given as runs of ``each`` equal samples: run r is the samples from r * each on.

    Runs are shuffled, samples are not: they are written out inside the chunk.
    """
    if each <= 0 or core % each or halo % each:
        raise InputError("chunks and halos are whole runs")
    _checked(core, halo)
    short = chunk_samples(runs, position, value, sr, core // each, halo // each, key)
    whole = lambda c: (F.col(c) * each).alias(c)
    return short.select(KEY, "sr", whole("n_samples"), "chunk", whole("start"), whole("lead"), whole("core"), F.flatten(F.transform("samples", lambda x: F.array_repeat(x, each))).alias("samples"))


def chunk_clips(pcm: DataFrame, core: int, halo: int) -> DataFrame:
    """Chunks of clips that are one row each (``decode_stimuli``): slices, in the JVM."""
    _checked(core, halo)
    n = F.size("samples")
    each = pcm.select(KEY, "sr", "samples", n.cast("long").alias("n_samples"), F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / core), F.lit(0)).cast("int"))).alias("chunk"))
    start = F.col("chunk").cast("long") * core
    lead = F.least(start, F.lit(halo)).cast("int")
    own = F.least(F.lit(core), F.col("n_samples") - start).cast("int")
    return each.select(KEY, "sr", "n_samples", "chunk", start.alias("start"), lead.alias("lead"), own.alias("core"), F.slice("samples", (start - lead + 1).cast("int"), lead + own + halo).alias("samples"))


def durations(chunks: DataFrame) -> DataFrame:
    """(stimulus_id, duration) of the recordings."""
    return chunks.where("chunk = 0").select(KEY, (F.col("n_samples") / F.col("sr")).alias("duration"))


def series_of_chunks(chunks: DataFrame, kernel: Callable[..., list[np.ndarray]], columns: list[str], hop: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, frame_idx, t, columns…): a kernel with one value for every centre ``f * hop``, over chunks.

    Starts and leads are multiples of ``hop``, and halos reach as far as a value depends on samples.
    ``extra``: double columns of ``chunks`` that the kernel takes after the samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, sr, n, start, lead, core = (batch.column(c)[k].as_py() for c in range(6))
                if start % hop or lead % hop:
                    raise InputError(f"chunks start at multiples of {hop}")
                found = kernel(batch.column(6)[k].values.to_numpy(), *(batch.column(7 + c)[k].as_py() for c in range(len(extra))))
                first, own = (start - lead) // hop, start // hop
                stop = n // hop + 1 if start + core >= n else -(-(start + core) // hop)
                frame = np.arange(own, stop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(frame), batch.schema.field(0).type), pa.array(frame.astype(np.int32)), pa.array(frame * hop / sr), *[pa.array(np.asarray(c, dtype=np.float64)[own - first : stop - first]) for c in found]],
                    names=[KEY, "frame_idx", "t", *columns],
                )

    kind = dict(chunks.dtypes)[KEY]
    narrow = chunks.select(KEY, "sr", "n_samples", "start", "lead", "core", "samples", *[F.col(c).cast("double") for c in extra])
    return narrow.mapInArrow(run, f"{KEY} {kind}, frame_idx int, t double" + "".join(f", `{c}` double" for c in columns))
