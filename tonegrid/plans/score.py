"""The planner: requested models → kernels → one native layer → frames (GRD7, TXT5-7, UDF1-3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..errors import ModelError
from ..functions.scalars import amplitude_to_db
from ..operators import beats_table, context, grid, intervals, ordered, recall, transcripts
from ..operators.grid import KEY
from ..sources.audio import decode_stimuli
from ..sources.chunks import durations, series_of_chunks
from .registry import MODELS, SOUND_EVENTS, Model, resolve

DEFAULT_HOP = 0.5
SR = 22_050
#: Kernel families and the native columns they yield.
_FAMILIES = ("loudness", "pitch", "spectral", "onsets", "tonal", "rhythm", "timbre")


@dataclass
class ScoreResult:
    """Lazy tables of a run; tables that were not asked for are None.

    ``meta``: per model its columns, context and rate, and the tables of its
    gate counts and of what its provider told; ``beats``, ``diarization``,
    ``speech_timing`` and ``recall``: one row per stimulus each. ``held``:
    waveforms and embeddings that are kept until ``release``.
    """

    frames: DataFrame | None = None
    transcript: DataFrame | None = None
    words: DataFrame | None = None
    recall: DataFrame | None = None
    beats: DataFrame | None = None
    speakers: DataFrame | None = None
    meta: dict = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        named = {"frames": self.frames, "transcript": self.transcript, "transcript_words": self.words, "recall": self.recall, "beats": self.beats, "speakers": self.speakers}
        return {k: v for k, v in named.items() if v is not None}

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()


def native_columns(models: list[Model]) -> list[str]:
    """Native-rate columns of the requested kernel models; derived ones are left to the grid."""
    out: list[str] = []
    for m in models:
        out += {"loudness": ["loudness_rms"], "onsets": ["onsets_strength", "onsets_tempo", "onsets_flag"]}.get(m.name, list(m.columns))
    return out


#: Frames that clips are put together for (16 kB each); a longer clip is on its own.
GROUP_FRAMES = 512


def _layer(y: np.ndarray, families: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(frame times, native series) of one clip."""
    _, t, out = _layers([y], families)
    return t, out


def _layers(ys: list[np.ndarray], families: list[str]) -> tuple[list[int], np.ndarray, dict[str, np.ndarray]]:
    """(first rows, frame times, native series) of clips, one after the other: frames, magnitudes and mel bands are computed once for all families."""
    from ..kernels import dsp

    views = [dsp.frames(y) for y in ys]
    sizes = [len(v) for v in views]
    starts = [0, *np.cumsum(sizes)[:-1].tolist()]
    f = np.concatenate(views) if len(views) > 1 else views[0]
    magnitudes = dsp.magnitudes_of(f) if {"spectral", "onsets", "tonal", "rhythm", "timbre"} & {*families} else None
    db = dsp.mel_db(magnitudes, starts=starts) if {"onsets", "rhythm", "timbre"} & {*families} else None
    env = dsp.onset_envelope(None, db, starts) if {"onsets", "rhythm"} & {*families} else None
    n, spans, out = len(f), dsp.clips(starts, len(f)), {}
    t = np.concatenate([dsp.frame_times(k) for k in sizes])
    for family in families:
        if family == "loudness":
            out["loudness_rms"] = dsp.levels(f)
        elif family == "pitch":
            out |= {f"pitch_{k}": v for k, v in dsp.pitches(f, starts).items()}
        elif family == "onsets":
            flag = np.full(n, np.nan)
            for a, b in spans:
                flag[a + dsp.pick_peaks(env[a:b])] = 1.0
            out |= {"onsets_strength": env, "onsets_tempo": dsp.tempo(env, starts=starts), "onsets_flag": flag}
        elif family == "rhythm":
            rate, series, cepstra = SR / dsp.HOP, np.full(n, np.nan), (db @ dsp.dct(14, 128).T)[:, :13]
            for a, b in spans:
                found = dsp.novelty(cepstra[a:b], rate)
                series[a + np.minimum((found["novelty_times"] * SR / dsp.HOP).astype(int), b - a - 1)] = found["novelty"]
            pulse = dsp.by_clip(lambda e: dsp.local_pulse(e, SR / dsp.HOP), env, starts)
            out |= {"rhythm_pulse_clarity": dsp.pulse_clarity(env, rate, starts), "rhythm_beat_strength": pulse, "rhythm_novelty": series}
        elif family == "spectral":
            out |= {f"spectral_{k}": v for k, v in dsp.spectral(None, magnitudes, starts=starts, zcr=np.concatenate([dsp.crossings(y) for y in ys])).items()}
        elif family == "tonal":
            out |= {f"tonal_{k}": v for k, v in dsp.tonal(None, magnitudes, starts=starts).items()}
        else:
            out |= {f"timbre_{k}": v for k, v in dsp.timbre(None, magnitudes, db=db).items()}
    return starts, t, out


def _grouped(column: pa.ListArray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, clips) of neighbouring rows that together have at most ``GROUP_FRAMES`` frames, one clip at least."""
    from ..kernels import dsp

    start, held, ys = 0, 0, []
    for k in range(len(column)):
        y = column[k].values.to_numpy()
        size = len(y) // dsp.HOP + 1
        if ys and held + size > GROUP_FRAMES:
            yield start, ys
            start, held, ys = k, 0, []
        ys.append(y)
        held += size
    if ys:
        yield start, ys


def native_layer(pcm: DataFrame, models: list[Model]) -> DataFrame:
    """(stimulus_id, frame_idx, t, features…): one Arrow pass, some clips at a time, only the kernels that were asked for."""
    families, columns = [m.name for m in models], native_columns(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ys in _grouped(batch.column(1)):
                starts, t, series = _layers(ys, families)
                sizes = np.diff([*starts, len(t)])
                keys = pa.array(np.repeat(np.arange(first, first + len(ys)), sizes))
                index = np.arange(len(t)) - np.repeat(starts, sizes)
                for start in range(0, len(t), 8192):
                    part = slice(start, start + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(keys[start : start + 8192]), pa.array(index[part].astype(np.int32)), pa.array(t[part]), *[pa.array(np.asarray(series[c], dtype=np.float64)[part]) for c in columns]],
                        names=[KEY, "frame_idx", "t", *columns],
                    )

    schema = StructType([StructField(KEY, StringType()), StructField("frame_idx", IntegerType()), StructField("t", DoubleType()), *[StructField(c, DoubleType()) for c in columns]])
    return pcm.select(KEY, "samples").mapInArrow(run, schema)


#: Families whose frames depend on the samples around them (and on the clip's peak): they run over chunks.
LOCAL = ("loudness", "spectral", "tonal", "timbre")
#: Samples that a chunk carries before and behind its own for them: the 3 s mean of chroma reaches farthest.
HALO = 80 * 512


def _local(y: np.ndarray, families: list[str], peak: float | None) -> list[np.ndarray]:
    from ..kernels import dsp

    magnitudes = dsp.stft(y) if {*families} - {"loudness"} else None
    out = []
    for family in families:
        if family == "loudness":
            out.append(dsp.rms(y))
        else:
            out += (dsp.timbre(y, magnitudes, peak=peak) if family == "timbre" else getattr(dsp, family)(y, magnitudes)).values()
    return out


def chunk_layer(chunks: DataFrame, models: list[Model]) -> DataFrame:
    """``native_layer`` of ``LOCAL`` families over chunks with halos of ``HALO`` samples: no row holds a whole clip.

    Cepstra are floored 80 dB under the clip's loudest band: a first pass takes its level from all chunks.
    """
    from ..kernels import dsp

    families, columns = [m.name for m in models], native_columns(models)
    if "timbre" not in families:
        return series_of_chunks(chunks, lambda y: _local(y, families, None), columns, dsp.HOP)
    levels = series_of_chunks(chunks, lambda y: [dsp.mel_peak(dsp.stft(y))], ["level"], dsp.HOP)
    peaks = levels.groupBy(KEY).agg(F.max("level").alias("peak"))
    return series_of_chunks(chunks.join(peaks, KEY), lambda y, peak: _local(y, families, peak), columns, dsp.HOP, ("peak",))


def chunk_frames(chunks: DataFrame, names: list[str], hop: float = DEFAULT_HOP) -> DataFrame:
    """Frames of ``LOCAL`` models on the grid from chunks (``sources.chunks``) at the kernels' rate."""
    models = resolve(names)
    if far := [m.name for m in models if m.name not in LOCAL]:
        raise ModelError(f"{', '.join(far)}: whole clips are needed")
    return _on_grid(chunk_layer(chunks, models), durations(chunks), models, hop)


def kernel_frames(pcm: DataFrame, names: list[str], hop: float = DEFAULT_HOP) -> DataFrame:
    """Frames of the kernel models on the grid, columns in request order."""
    return layer_frames(pcm, pcm.select(KEY, "duration"), names, hop)


def layer_frames(sounds: DataFrame, durations: DataFrame, names: list[str], hop: float = DEFAULT_HOP) -> DataFrame:
    """``kernel_frames`` of (stimulus_id, samples), where durations are known without samples."""
    models = resolve(names)
    return _on_grid(native_layer(sounds, models), durations, models, hop)


def _on_grid(native: DataFrame, durations: DataFrame, models: list[Model], hop: float) -> DataFrame:
    maxes = [c for m in models for c in m.maxes]
    means = [c for c in native_columns(models) if c not in maxes and c != "onsets_flag"]
    flags = ("onsets_flag",) if any(m.name == "onsets" for m in models) else ()
    reduced = grid.reduce_windows(native, durations, hop, tuple(means), tuple(maxes), flags)
    dense = grid.spine(durations, hop).join(reduced.drop("_events"), [KEY, "k"], "left")
    if any(m.name == "onsets" for m in models):
        dense = dense.withColumn("onsets_rate", F.coalesce("onsets_flag", F.lit(0.0)) / hop)
    if any(m.name == "loudness" for m in models):
        db = amplitude_to_db(F.col("loudness_rms"))
        dense = dense.withColumn("loudness_db", F.greatest(db, F.max(db).over(Window.partitionBy(KEY)) - 80))
    return dense.select(KEY, "k", "time", *[c for m in models for c in m.columns])


class _Run:
    """What the models of one run share: a waveform per rate, an embedding pass per family, the speech series."""

    def __init__(self, stimuli: DataFrame | None, hop: float, providers: dict, out: ScoreResult, chunks: Callable[[int, float], DataFrame] | None = None, profiles: dict | None = None):
        self.stimuli, self.hop, self.providers, self.out, self.chunks = stimuli, hop, providers, out, chunks
        self.profile = (profiles or {}).get
        self._pcm: dict[int, DataFrame] = {}
        self._passes: dict[str, DataFrame] = {}

    def pcm(self, sr: int) -> DataFrame:
        """SRC4: every clip is decoded once per rate."""
        if self.stimuli is None:
            raise ModelError("a model that needs whole clips was asked for, and only chunks are given")
        if sr not in self._pcm:
            self._pcm[sr] = decode_stimuli(self.stimuli, sr).persist()
            self.out.held.append(self._pcm[sr])
        return self._pcm[sr]

    @property
    def durations(self) -> DataFrame:
        return self.pcm(SR).select(KEY, "duration") if self.chunks is None else durations(self.chunks(SR, HALO / SR))

    def embedding(self, m: Model) -> DataFrame:
        """EMB5: one pass for all models of a family; music_emotion and sound_events read the vectors of clap."""
        from ..providers.base import embed, embed_chunks

        name = m.provider
        if name not in self._passes:
            model = self.providers[name]
            sr = getattr(model, "sr", m.sr)
            vectors = embed(self.pcm(sr), model, self.hop, profile=self.profile(name)) if self.chunks is None else embed_chunks(self.chunks(sr, (getattr(model, "window_sec", None) or self.hop) + 0.1), model, self.hop, profile=self.profile(name))
            self._passes[name] = vectors.persist()
            self.out.held.append(self._passes[name])
        return self._passes[name]

    def series(self, name: str) -> DataFrame:
        from ..providers.base import series

        key = f"series {name}"
        if key not in self._passes:
            model = self.providers[name]
            self._passes[key] = series(self.pcm(getattr(model, "sr", MODELS[name].sr)), model, self.profile(name)).persist()
            self.out.held.append(self._passes[key])
        return self._passes[key]

    def speech(self, width: float) -> DataFrame:
        """CTX4: mean speech probability of every context of ``width`` seconds."""
        from ..providers.derived import speech_fraction

        return speech_fraction(self.series("speech"), grid.spine(self.durations, self.hop), self.durations, width)


def _provided(run: _Run, m: Model, probe: dict | None, bank: DataFrame | None) -> DataFrame:
    """The frames of one provider-fed model: its provider's output through its gate (FRM10, FRM12-18)."""
    from ..providers import derived

    if callable(run.providers.get(m.name)):
        return run.providers[m.name](run.pcm(m.sr), run.hop)
    counts = {}
    if m.kind == "embedding":
        frames = run.embedding(m).select(KEY, "k", F.col("embedding").alias(m.name))
    elif m.gate == "silence":
        marked = derived.silence_marked(run.embedding(m))
        if m.name == "music_emotion":
            frames = derived.music_emotion(marked, probe)
        else:
            frames = derived.sound_events(marked, bank if bank is not None else derived.prompt_bank(marked.sparkSession, run.providers[m.provider]), list(SOUND_EVENTS))
        counts = (marked, {"n_windows_silence_gated": F.col("silent")})
    elif m.name == "speech":
        frames = derived.speech_probability(run.series("speech"), run.durations, run.hop).drop("time")
    elif m.name == "speech_emotion":
        raw = run.embedding(m).select(KEY, "k", F.col("embedding").alias("outputs"))
        fractions = run.speech(m.window_sec)
        frames = derived.speech_emotion(raw, fractions)
        counts = (fractions, {"n_gated_windows": F.col("speech_fraction") < context.SPEECH_FRACTION})
    elif m.name == "egemaps":
        fractions = run.speech(run.hop)
        frames = derived.voice_parameters(run.series(m.name), fractions, run.durations, run.hop)
        counts = (fractions, {"n_gated_windows": F.col("speech_fraction") < context.SPEECH_FRACTION})
    else:
        frames = derived.psychoacoustic(run.series(m.name), run.durations, run.hop)
        loud = F.col("psychoacoustic_loudness")
        counts = (frames, {"n_sharpness_gated_windows": ~F.coalesce(loud >= context.SHARPNESS_SONE, F.lit(False))})
    if counts:
        run.out.meta["models"][m.name]["gates"] = context.gated_counts(*counts)
    return frames


def _needs(m: Model) -> list[str]:
    return [m.provider, *(["speech"] if m.gate == "speech" else [])]


def _rows(run: _Run, m: Model) -> DataFrame:
    """TXT1, TXT8, UDF3: the rows of an event or segment provider, and what it tells about its clips."""
    from ..providers import base

    model = run.providers[m.name]
    pcm = run.pcm(getattr(model, "sr", m.sr))
    told = base.info(pcm, model, run.profile(m.name))
    if told is not None:
        run.out.meta["models"][m.name]["info"] = told
    return base.rows(pcm, model, run.profile(m.name))


def _decoded(run: _Run, m: Model) -> DataFrame:
    """TXT1-3: decoder output at 16 kHz; degenerate clips are decoded again with the penalty, where the provider takes one."""
    from ..providers import base

    model = run.providers[m.name]
    transcripts.check_rate(getattr(model, "sr", m.sr))
    decoded = _rows(run, m).persist()
    run.out.held.append(decoded)
    if not hasattr(model, "penalised"):
        return decoded
    again = lambda bad, penalty: base.rows(run.pcm(model.sr).join(bad, KEY, "left_semi"), model.penalised(penalty), run.profile(m.name))
    return transcripts.retry(decoded, again)


def recordings(spark: SparkSession, path: str, seconds: float = 60.0) -> Callable[[int, float], DataFrame]:
    """A reader of chunks of the WAV files under ``path``, for ``score``."""
    from ..sources.chunks import read_chunks

    return lambda sr, halo: read_chunks(spark, path, sr, seconds, halo)


def score(
    stimuli: DataFrame | None,
    names: list[str],
    hop: float = DEFAULT_HOP,
    wordpool: DataFrame | None = None,
    tables: dict[str, DataFrame] | None = None,
    providers: dict | None = None,
    probe: dict[str, tuple[list[float], float]] | None = None,
    bank: DataFrame | None = None,
    verbatim: bool = False,
    chunks: Callable[[int, float], DataFrame] | None = None,
    profiles: dict | None = None,
) -> ScoreResult:
    """Score a corpus of stimuli with the named models.

    ``providers``: providers by model name (or a family's: ``clap`` also feeds
    ``music_emotion`` and ``sound_events``, ``speech`` gates ``speech_emotion``
    and ``egemaps``); what is not given is looked up among the registered ones.
    ``tables``: ready outputs of event and segment models (``words``,
    ``transcript``, ``beats``, ``speakers``) instead of a provider. ``probe``:
    read-outs of ``music_emotion``; ``bank``: category vectors of
    ``sound_events``, by default those of the fixed prompts. ``chunks``: a reader
    of chunks by (rate, seconds of halo), for instance ``recordings(spark, path)``;
    what is local (``LOCAL`` kernels and embeddings) then reads chunks of
    recordings of any length, and only other models read ``stimuli``, which may be
    None without them. ``profiles``: resource profiles of provider passes by the
    provider's name (``providers.base.device_profile``). Steps run in a fixed
    order: frames, beats, speakers, transcript, then recall, voice and speaker
    joins.
    """
    if hop <= 0:
        raise ValueError("hop must be positive")
    from ..providers import base

    models, tables, providers = resolve(names), tables or {}, dict(providers or {})
    ready = {"beats": "beats", "diarize": "speakers", "transcribe": "transcript"}
    missing = []
    for m in models:
        if m.native or ready.get(m.name) in tables:
            continue
        for name in [m.name] if m.name in providers and callable(providers[m.name]) else _needs(m):
            if name not in providers and base.available(name):
                providers[name] = base.provider(name)
            if name not in providers:
                missing.append(m.name if name == m.provider else f"{name} (for {m.name})")
        if m.name == "music_emotion" and not callable(providers.get(m.name)) and not probe:
            raise ModelError("music_emotion needs a probe")
    if missing:
        raise ModelError(f"no provider for {', '.join(dict.fromkeys(missing))}")
    out = ScoreResult(meta={"models": {m.name: {"columns": list(m.columns), "window_sec": m.window_sec, "sr": m.sr} for m in models}, "hop": hop})
    run = _Run(stimuli, hop, providers, out, chunks, profiles)
    asked = {m.name: m for m in models}
    framed = [m for m in models if m.level == "frame"]
    if framed:
        kernels = [m.name for m in framed if m.native]
        families = []
        if chunks is not None and (near := [n for n in kernels if n in LOCAL]):
            families.append(chunk_frames(chunks(SR, HALO / SR), near, hop))
            kernels = [n for n in kernels if n not in LOCAL]
        if kernels:
            families.append(kernel_frames(run.pcm(SR), kernels, hop))
        families += [_provided(run, m, probe, bank) for m in framed if not m.native]
        out.frames = grid.assemble(grid.spine(run.durations, hop), families)
        spread = [c for m in framed for c in (m.columns if m.kind != "embedding" else (m.name,)) if c in out.frames.columns]
        rest = [c for c in out.frames.columns if c not in (KEY, "k", "time", *spread)]
        out.frames = out.frames.select(KEY, "k", "time", *spread, *rest)
    if "beats" in asked:
        found = tables["beats"] if "beats" in tables else _rows(run, asked["beats"])
        out.beats = beats_table.downbeats(found, tables.get("downbeats"))
        out.meta["beats"] = ordered.beat_info(out.beats)
    if "diarize" in asked:
        turns = tables["speakers"] if "speakers" in tables else _rows(run, asked["diarize"])
        out.speakers = ordered.number_turns(turns)
        out.meta["diarization"] = ordered.speaker_summary(turns)
    if "transcribe" in asked:
        if "transcript" in tables:
            out.transcript, out.words = tables["transcript"], tables.get("words")
        else:
            out.transcript, out.words = transcripts.flatten(_decoded(run, asked["transcribe"]), verbatim)
        if out.words is not None:
            out.meta["speech_timing"] = ordered.speech_timing(out.words)
            if wordpool is not None:
                out.recall = recall.annotate_recall(out.words, wordpool)
                out.meta["recall"] = recall.recall_summary(out.recall, wordpool.count())
        if out.frames is not None and "pitch_f0" in out.frames.columns:
            out.transcript = intervals.segment_voice(out.transcript, out.frames, hop)
        if out.speakers is not None:
            out.transcript = intervals.majority_speaker(out.transcript, out.speakers)
            if out.words is not None:
                out.words = intervals.word_speakers(out.words, out.speakers, "pos")
    return out


__all__ = ["DEFAULT_HOP", "HALO", "LOCAL", "MODELS", "ScoreResult", "chunk_frames", "kernel_frames", "native_layer", "recordings", "score"]
