"""Audio sources (SRC1-4): files to waveforms to native layers, keyed by stimulus."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import tempfile
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError

AUDIO = (".flac", ".m4a", ".mp3", ".ogg", ".wav")
VIDEO = (".mkv", ".mov", ".mp4", ".webm")


def input_type(path: str) -> str:
    """SRC1: 'audio' or 'video' by suffix; a missing file or another suffix is an InputError. A folder is a corpus: 'folder'."""
    if os.path.isdir(path):
        return "folder"
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in AUDIO + VIDEO:
        raise InputError(f"unsupported input {suffix or path!r}; supported: {', '.join(sorted(AUDIO + VIDEO))}")
    if not os.path.exists(path):
        raise InputError(f"no such file: {path}")
    return "audio" if suffix in AUDIO else "video"


def input_type_column(path: Column) -> Column:
    """SRC1 for a corpus: NULL for rows to quarantine."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(*AUDIO), "audio").when(suffix.isin(*VIDEO), "video")


def stimulus_id(path: Column) -> Column:
    """SNK2: the file's stem."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def resample_range(y: np.ndarray, offset: int, n: int, source: int, target: int, first: int, last: int) -> np.ndarray:
    """Samples ``[first, last)`` at rate ``target`` of a signal of n samples at rate ``source``; ``y`` are its samples from ``offset`` on.

    Band-limited, by a windowed-sinc polyphase sum, a block of outputs at a time;
    beyond its ends the signal is 0. ``y`` must reach as far as the sums do.
    """
    if source == target:
        return np.asarray(y[first - offset : last - offset], dtype=np.float32)
    cutoff, reach = min(1.0, target / source), 32
    half = int(np.ceil(reach / cutoff))
    offsets = np.arange(-half, half + 1)
    y = np.asarray(y, dtype=np.float64)
    out = np.empty(last - first, dtype=np.float32)
    for start in range(first, last, 8192):
        at = np.arange(start, min(last, start + 8192)) * source / target
        base = np.floor(at).astype(np.int64)
        low, high = int(base[0]) - half, int(base[-1]) + half + 1
        a, b = max(low, 0), min(high, n)
        if b > a and (a < offset or b > offset + len(y)):
            raise InputError("resampling needs more samples than it was given")
        near = np.zeros(high - low)
        near[a - low : max(a, b) - low] = y[a - offset : max(a, b) - offset]
        distance = (at - base)[:, None] - offsets[None, :]
        kernel = cutoff * np.sinc(cutoff * distance) * np.cos(np.pi * np.clip(distance / (half + 1), -0.5, 0.5) / 1.0) ** 2
        out[start - first : start - first + len(at)] = (near[base[:, None] + offsets[None, :] - low] * kernel).sum(axis=1)
    return out


def resample(y: np.ndarray, source: int, target: int) -> np.ndarray:
    """A whole signal at another rate."""
    if source == target or not len(y):
        return np.asarray(y, dtype=np.float32)
    return resample_range(y, 0, len(y), source, target, 0, int(np.ceil(len(y) * target / source)))


def pcm_to_float(raw: bytes, width: int, channels: int) -> np.ndarray:
    """PCM bytes to the mean of the channels, full scale at 1."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1)


def decode_wav(content: bytes, sr: int) -> np.ndarray:
    """SRC2: PCM bytes to mono float32 at ``sr``; channels are averaged."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    return resample(pcm_to_float(raw, width, channels), rate, sr)


def decode(content: bytes, path: str, sr: int) -> np.ndarray:
    """SRC2-3: WAV by the standard library, other kinds by an ``ffmpeg`` process where there is one."""
    if path.lower().endswith(".wav"):
        return decode_wav(content, sr)
    if shutil.which("ffmpeg") is None:
        raise InputError(f"{path}: decoding needs ffmpeg")
    with tempfile.NamedTemporaryFile(suffix=os.path.splitext(path)[1]) as source:  # a task's own file: some containers need seeking
        source.write(content)
        source.flush()
        done = subprocess.run(["ffmpeg", "-v", "error", "-i", source.name, "-vn", "-ac", "1", "-ar", str(sr), "-f", "wav", "pipe:1"], capture_output=True)
    if done.returncode:
        raise InputError(f"{path}: " + "\n".join(done.stderr.decode("utf-8", "replace").splitlines()[-8:]))
    head = done.stdout.find(b"data")
    rate = int.from_bytes(done.stdout[24:28], "little")
    if head < 0 or rate != sr:
        raise InputError(f"{path}: decoded at {rate} Hz instead of {sr}")
    return np.frombuffer(done.stdout[head + 8 :], "<i2").astype(np.float32) / 32768


def encode_wav(y: np.ndarray, sr: int) -> bytes:
    """16-bit mono PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(sr)
        f.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_stimuli(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(stimulus_id, path, kind, content) of every file under ``path``; with ``strict`` an unknown kind fails the read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = input_type_column(F.col("path"))
    if strict:
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported input "), F.col("path"))).cast("string"))
    return files.select(stimulus_id(F.col("path")).alias("stimulus_id"), "path", kind.alias("kind"), "content")


def decode_stimuli(stimuli: DataFrame, sr: int) -> DataFrame:
    """SRC4: (stimulus_id, sr, duration, samples) at one rate; persist it when several layers read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a clip at a time bounds memory
                y = decode(batch.column(2)[k].as_py(), batch.column(1)[k].as_py(), sr)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([sr], pa.int32()), pa.array([len(y) / sr]), pa.array([y], pa.list_(pa.float32()))],
                    names=["stimulus_id", "sr", "duration", "samples"],
                )

    return stimuli.select("stimulus_id", "path", "content").mapInArrow(run, "stimulus_id string, sr int, duration double, samples array<float>")
