"""Providers of learned models (FRM10, FRM12-14, FRM17-18, TXT1, TXT8, UDF1-4).

Weights are never part of this library. A provider says what it needs and
yields; the engine decodes, cuts context windows and batches them, runs the
provider inside ``mapInArrow`` with one instance per Python worker, and applies
the gates. There are three shapes of output:

* *windows* (``embed``): one vector for the context of every grid row,
* *series* (``series``): values at the provider's own rate,
* *rows* (``rows``): a table function, any number of rows per clip.

A provider may also tell about a clip (``info``): pairs that end up beside the
model's entry in the provenance document.

Where a pass runs is a resource profile (``device_profile``): its stage, and only
it, asks for executors with devices, where the cluster schedules by stage.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from ..errors import ModelError
from ..operators.grid import KEY


class Provider(Protocol):
    """What a learned model implements; only ``run`` of its shape is needed."""

    name: str
    sr: int
    window_sec: float | None
    columns: tuple[str, ...]

    @staticmethod
    def available() -> bool: ...

    def load(self) -> None: ...

    def run(self, windows: list[np.ndarray]) -> np.ndarray:
        """Windows: one row of ``columns`` (or one vector) per window."""
        ...

    def clip(self, y: np.ndarray, sr: int):
        """Series: ``{"t": times, column: values}``. Rows: a list of dicts by ``schema``."""
        ...


@dataclass
class StubProvider:
    """A deterministic stand-in: statistics of the window, for tests and dry runs."""

    name: str = "stub"
    sr: int = 16_000
    window_sec: float | None = 2.0
    columns: tuple[str, ...] = ("vector",)
    dims: int = 8
    loads: int = field(default=0, compare=False)

    @staticmethod
    def available() -> bool:
        return True

    def load(self) -> None:
        self.loads += 1

    def run(self, windows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(windows), self.dims))
        lengths = np.array([len(w) for w in windows])
        for n in set(lengths[lengths >= self.dims].tolist()):
            same = np.flatnonzero(lengths == n)
            squares = np.square(np.stack([windows[k] for k in same]), dtype=np.float64)
            sizes = n // self.dims + (np.arange(self.dims) < n % self.dims)
            out[same] = np.sqrt(np.add.reduceat(squares, np.cumsum(sizes) - sizes, axis=1) / sizes)
        for k in np.flatnonzero(lengths < self.dims):
            out[k, : lengths[k]] = np.abs(windows[k])
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    def texts(self, prompts: list[str]) -> np.ndarray:
        """Vectors of prompts in the same space: letter counts folded into ``dims``."""
        out = np.zeros((len(prompts), self.dims))
        for k, prompt in enumerate(prompts):
            for c in prompt.encode():
                out[k, c % self.dims] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class StubSpeech:
    """Speech probability of 512-sample blocks: 1 where the block is louder than ``level``, else 0; the last block is padded."""

    name: str = "stub_speech"
    sr: int = 16_000
    window_sec: float | None = None
    columns: tuple[str, ...] = ("prob",)
    level: float = 0.01
    block: int = 512

    @staticmethod
    def available() -> bool:
        return True

    def load(self) -> None:
        pass

    def clip(self, y: np.ndarray, sr: int) -> dict[str, np.ndarray]:
        n = -(-len(y) // self.block)
        blocks = np.pad(np.asarray(y, dtype=np.float64), (0, n * self.block - len(y))).reshape(n, self.block)
        return {"t": (np.arange(n) + 0.5) * self.block / sr, "prob": (np.sqrt((blocks**2).mean(axis=1)) > self.level).astype(float)}


@dataclass
class StubTurns:
    """Speaker turns: runs of loud half seconds, speakers in turn."""

    name: str = "stub_turns"
    sr: int = 16_000
    num_speakers: int = 2
    schema: str = "speaker string, onset double, offset double"

    @staticmethod
    def available() -> bool:
        return True

    def load(self) -> None:
        pass

    def clip(self, y: np.ndarray, sr: int) -> list[dict]:
        step = sr // 2
        loud = [np.sqrt(np.mean(np.asarray(y[i : i + step], dtype=np.float64) ** 2)) > 0.01 for i in range(0, len(y), step)] + [False]
        out, start = [], None
        for i, on in enumerate(loud):
            if on and start is None:
                start = i
            if not on and start is not None:
                out.append({"speaker": f"S{len(out) % self.num_speakers}", "onset": start * 0.5, "offset": min(i * 0.5, len(y) / sr)})
                start = None
        return out

    def info(self, y: np.ndarray, sr: int) -> dict:
        return {"speaker_hint": self.num_speakers}


_REGISTRY: dict[str, type] = {"stub": StubProvider}


def register(name: str, kind: type) -> None:
    """Make a provider known under a model's name (or the name of its family)."""
    _REGISTRY[name] = kind


def available(name: str) -> bool:
    return name in _REGISTRY and _REGISTRY[name].available()


def provider(name: str, **options):
    """An instance by name; unknown or unavailable providers are a ModelError. Options that are None are left out."""
    if name not in _REGISTRY:
        raise ModelError(f"no provider for {name!r}: register one")
    if not _REGISTRY[name].available():
        raise ModelError(f"provider {name!r} is not available here")
    return _REGISTRY[name](**{k: v for k, v in options.items() if v is not None})


def device_profile(devices: float = 1, executor_devices: int | None = None, cpus: int = 1, memory: str | None = None, script: str | None = None, resource: str = "gpu"):
    """UDF4: what a provider's pass asks of its tasks, a share of a device included.

    With ``executor_devices`` the stage also gets executors of its own (dynamic
    allocation), which ``script`` discovers devices on; without, tasks are fitted
    into the executors that run.
    """
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    builder = ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus).resource(resource, devices))
    if executor_devices is not None:
        asked = ExecutorResourceRequests().resource(resource, executor_devices, script or "")
        builder = builder.require(asked.memory(memory) if memory else asked)
    elif memory or script:
        raise ModelError("memory and script are of executors: give executor_devices")
    return builder.build


def context_windows(y: np.ndarray, sr: int, hop: float, n: int, seconds: float) -> Iterator[np.ndarray]:
    """CTX1-2: the clamped context of every grid window; a short clip is its own context."""
    duration, size = len(y) / sr, int(seconds * sr)
    for k in range(n):
        start = int(min(max((k + 0.5) * hop - seconds / 2, 0.0), max(duration - seconds, 0.0)) * sr)
        yield y[start : start + min(len(y), size)]


def _loaded(model):
    """``model`` with its weights read, once per Python worker's copy."""
    if not getattr(model, "_ready", False):
        model.load()
        model._ready = True
    return model


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy()


#: Vectors of an Arrow batch on its way back; a model still gets ``size`` contexts a call.
OUT_ROWS = 2048


def _levels(windows: list[np.ndarray]) -> list[float]:
    """RMS of every window; windows of one length at once."""
    if len(windows[0]) and len({len(w) for w in windows}) == 1:
        return np.sqrt(np.mean(np.square(np.stack(windows), dtype=np.float64), axis=1)).tolist()
    return [float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0 for x in windows]


def _batched(contexts: Iterator[tuple[str, int, np.ndarray]], model: Provider, hop: float, size: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Vectors of (stimulus, k, context), ``size`` contexts a call of the model, whatever stimuli they are of."""
    stimuli, ks, vectors, levels = [], [], [], []

    def out() -> pa.RecordBatch:
        k = np.array(ks, dtype=np.int32)
        ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vectors), pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(stimuli, kind), pa.array(k), pa.array((k + 0.5) * hop), lists, pa.array(levels, pa.float64())], names=[KEY, "k", "time", "embedding", "context_rms"])

    while held := list(itertools.islice(contexts, size)):
        named, at, windows = map(list, zip(*held, strict=True))
        stimuli += named
        ks += at
        vectors += [np.asarray(v, dtype=np.float32) for v in model.run(windows)]
        levels += _levels(windows)
        if len(ks) >= OUT_ROWS:
            yield out()
            stimuli, ks, vectors, levels = [], [], [], []
    if ks:
        yield out()


def _embedded(kind: str) -> str:
    return f"{KEY} {kind}, k int, time double, embedding array<float>, context_rms double"


def embed(pcm: DataFrame, model: Provider, hop: float, batch: int = 8, profile=None) -> DataFrame:
    """EMB5, FRM13-14: (stimulus_id, k, time, embedding, context_rms), one pass shared by all models of a family; persist the result.

    The level of the context that the silence gate asks for is taken in the same pass.
    """

    def contexts(batches, seconds: float):
        for stimulus, sr, y in _clips(batches):
            n = max(1, int(np.ceil(round(len(y) / sr / hop, 9))))
            for k, w in enumerate(context_windows(y, sr, hop, n, seconds)):
                yield stimulus, k, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _loaded(model)
        for part in batches:
            yield from _batched(contexts([part], ready.window_sec or hop), ready, hop, batch, part.schema.field(0).type)

    return pcm.select(KEY, "sr", "samples").mapInArrow(run, _embedded(dict(pcm.dtypes)[KEY]), profile=profile)


def embed_chunks(chunks: DataFrame, model: Provider, hop: float, batch: int = 8, profile=None) -> DataFrame:
    """``embed`` over chunks (``sources.chunks``), whose halos must be a context or longer.

    A context belongs to the chunk in which it starts, so every one is cut from one
    row; batches are filled across chunks and stimuli.
    """

    def contexts(batches, seconds: float):
        for part in batches:
            for i in range(part.num_rows):
                stimulus, sr, n, start, lead, core = (part.column(c)[i].as_py() for c in range(6))
                y, size = part.column(6)[i].values.to_numpy(), int(seconds * sr)
                last, count = int(max(n / sr - seconds, 0.0) * sr), max(1, int(np.ceil(round(n / sr / hop, 9))))
                near = lambda sample: int((sample / sr + seconds / 2) / hop)
                k = np.arange(max(near(start) - 2, 0) if start else 0, count if last < start + core else min(near(start + core) + 2, count))
                at = (np.minimum(np.maximum((k + 0.5) * hop - seconds / 2, 0.0), max(n / sr - seconds, 0.0)) * sr).astype(np.int64)
                owned = (at >= start) & (at < start + max(core, 1))
                for mine, begin in zip(k[owned].tolist(), at[owned].tolist(), strict=True):
                    own = y[begin - start + lead :][: min(n, size)]
                    if len(own) < min(n - begin, size):
                        raise ModelError(f"contexts of {seconds} s need halos as long")
                    yield stimulus, mine, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _loaded(model)
        first = next(batches, None)
        if first is not None:
            yield from _batched(contexts(itertools.chain([first], batches), ready.window_sec or hop), ready, hop, batch, first.schema.field(0).type)

    return chunks.select(KEY, "sr", "n_samples", "start", "lead", "core", "samples").mapInArrow(run, _embedded(dict(chunks.dtypes)[KEY]), profile=profile)


def series(pcm: DataFrame, model: Provider, profile=None) -> DataFrame:
    """FRM10, FRM12, FRM18: (stimulus_id, t, columns…) at the provider's own rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stimulus, sr, y in _clips(batches):
            found = _loaded(model).clip(y, sr)
            names = ["t", *model.columns]
            yield pa.RecordBatch.from_arrays([pa.array([stimulus] * len(found["t"]), pa.string()), *[pa.array(np.asarray(found[c], dtype=np.float64)) for c in names]], names=[KEY, *names])

    return pcm.select(KEY, "sr", "samples").mapInArrow(run, f"{KEY} string, t double" + "".join(f", `{c}` double" for c in model.columns), profile=profile)


def rows(pcm: DataFrame, model: Provider, profile=None) -> DataFrame:
    """TXT1, TXT8, UDF3: a table function, any number of rows of ``model.schema`` per clip."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = _parse_datatype_string(f"{KEY} string, {model.schema}")
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stimulus, sr, y in _clips(batches):
            yield pa.RecordBatch.from_pylist([{KEY: stimulus, **r} for r in _loaded(model).clip(y, sr)], schema=arrow)

    return pcm.select(KEY, "sr", "samples").mapInArrow(run, kinds, profile=profile)


def info(pcm: DataFrame, model: Provider, profile=None) -> DataFrame | None:
    """UDF2: (stimulus_id, info as JSON) of a provider that tells about clips."""
    if not hasattr(model, "info"):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stimulus, sr, y in _clips(batches):
            yield pa.RecordBatch.from_arrays([pa.array([stimulus]), pa.array([json.dumps(_loaded(model).info(y, sr))])], names=[KEY, "info"])

    return pcm.select(KEY, "sr", "samples").mapInArrow(run, f"{KEY} string, info string", profile=profile)
