"""Chunks with halos give what whole clips give."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.errors import InputError, ModelError
from tonegrid.kernels import dsp
from tonegrid.plans.score import HALO, LOCAL, chunk_frames, kernel_frames, recordings, score
from tonegrid.providers.base import StubProvider, embed, embed_chunks
from tonegrid.sources import chunks as C
from tonegrid.sources.audio import decode_stimuli, read_stimuli

SR = 22_050


def signal(seconds, seed, sr=SR):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * sr)) / sr
    return (0.4 * np.sin(2 * np.pi * (200 + 90 * np.sin(t)) * t) * (np.sin(1.7 * t) > -0.3) + 0.05 * rng.standard_normal(len(t))).astype(np.float32)


@pytest.fixture(scope="module")
def pcm(spark):
    rows = [(f"s{k}", SR, n / SR, y.tolist()) for k, s in enumerate((9.3, 4.0, 0.03)) for y in [signal(s, k)] for n in [len(y)]]
    rows.append(("exact", SR, 512 * 160 / SR, signal(512 * 160 / SR + 1e-9, 9)[: 512 * 160].tolist()))
    return spark.createDataFrame(rows, "stimulus_id string, sr int, duration double, samples array<float>").cache()


@pytest.mark.parametrize("core", [512 * 20, 512 * 160, 512 * 1000])
def test_frames_equal_those_of_whole_clips(pcm, core):
    cut = C.chunk_clips(pcm, core, HALO)
    got = {(r.stimulus_id, r.k): r for r in chunk_frames(cut, list(LOCAL), 0.25).collect()}
    want = {(r.stimulus_id, r.k): r for r in kernel_frames(pcm, list(LOCAL), 0.25).collect()}
    assert got.keys() == want.keys() and len(got) > 60
    for key, r in want.items():
        for name, value in r.asDict().items():
            mine = got[key][name]
            assert (mine is None) == (value is None) and (value is None or isinstance(value, str) or mine == pytest.approx(value, rel=1e-6, abs=1e-9)), (key, name)


def test_models_of_whole_clips_are_refused(pcm):
    with pytest.raises(ModelError):
        chunk_frames(C.chunk_clips(pcm, 51_200, HALO), ["pitch"])


@pytest.mark.parametrize(("core", "batch"), [(512 * 20, 3), (512 * 100, 8)])
def test_contexts_equal_those_of_whole_clips(pcm, core, batch):
    stub = StubProvider(sr=SR, window_sec=2.0)
    got = {(r.stimulus_id, r.k): r for r in embed_chunks(C.chunk_clips(pcm, core, 512 * 90), stub, 0.5, batch).collect()}
    want = {(r.stimulus_id, r.k): r for r in embed(pcm, stub, 0.5, batch).collect()}
    assert got.keys() == want.keys()
    for key, r in want.items():
        assert got[key].embedding == r.embedding and got[key].context_rms == r.context_rms and got[key].time == r.time
    with pytest.raises(Exception, match="halos"):
        embed_chunks(C.chunk_clips(pcm, core, 512), stub, 0.5, batch).collect()


def write(path, y, sr, channels=1, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(sr)
        scaled = (np.clip(y, -1, 1) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        if width == 1:
            f.writeframes((np.repeat(scaled, channels) + 128).astype(np.uint8).tobytes())
        elif width == 3:
            f.writeframes(b"".join(struct.pack("<i", v)[:3] for v in np.repeat(scaled, channels).tolist()))
        else:
            f.writeframes(np.repeat(scaled, channels).astype({2: "<i2", 4: "<i4"}[width]).tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("wavs")
    (top / "sub").mkdir()
    write(top / "a.wav", signal(7.0, 1, 44_100), 44_100, 2)
    write(top / "sub" / "b.WAV", signal(3.3, 2, 16_000), 16_000, 1, 3)
    write(top / "c.wav", signal(5.0, 3), SR, 1, 4)
    write(top / "d.wav", signal(1.0, 4, 8_000), 8_000, 1, 1)
    write(top / "e.wav", np.zeros(0), SR)
    return str(top)


@pytest.mark.parametrize(("seconds", "span"), [(0.5, 50_000), (2.0, 1 << 26), (60.0, 3_000)])
def test_files_by_byte_range_equal_whole_files(spark, folder, seconds, span):
    whole = {r.stimulus_id: np.array(r.samples, np.float32) for r in decode_stimuli(read_stimuli(spark, folder + "/*.wav"), SR).collect()}
    whole |= {r.stimulus_id: np.array(r.samples, np.float32) for r in decode_stimuli(read_stimuli(spark, folder + "/sub"), SR).collect()}
    rows = C.read_chunks(spark, folder, SR, seconds, 0.3, rangeBytes=span).collect()
    joined = {}
    for r in sorted(rows, key=lambda r: (r.stimulus_id, r.chunk)):
        y = np.array(r.samples, np.float32)
        assert r.lead % 512 == 0 and r.start % 512 == 0 and len(y) <= r.lead + r.core + 0.35 * SR + 512
        assert (y == whole[r.stimulus_id][r.start - r.lead : r.start - r.lead + len(y)]).all() and r.n_samples == len(whole[r.stimulus_id])
        joined.setdefault(r.stimulus_id, []).append(y[r.lead : r.lead + r.core])
    assert {k: sum(map(len, v)) for k, v in joined.items()} == {k: len(v) for k, v in whole.items()}


def test_score_of_recordings(spark, folder):
    """Chunked and whole runs of the planner agree; nothing but chunks is read."""
    stub = {"clap": StubProvider(sr=16_000, window_sec=1.0)}
    names = ["loudness", "spectral", "clap"]
    got = score(None, names, 0.5, providers=stub, chunks=recordings(spark, folder, 1.0)).frames
    files = read_stimuli(spark, folder + "/*.wav").unionByName(read_stimuli(spark, folder + "/sub"))
    want = score(files, names, 0.5, providers=stub).frames
    assert got.columns == want.columns
    a, b = ({(r.stimulus_id, r.k): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for key, r in b.items():
        assert a[key].loudness_rms == pytest.approx(r.loudness_rms, rel=1e-6, abs=1e-9) and a[key].clap == pytest.approx(r.clap, abs=1e-6)
    with pytest.raises(ModelError, match="whole clips"):
        score(None, ["pitch"], chunks=recordings(spark, folder, 1.0))


def test_samples_in_a_table(spark):
    x = np.arange(1000.0)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [(None, i, float(i)) for i in range(70)], "stimulus_id string, i int, x double").repartition(4)
    rows = C.chunk_samples(df, "i", "x", 100, 64, 16).collect()
    assert len(rows) == 16 + 2
    for r in rows:
        assert r.samples == [float(v) for v in range(r.start - r.lead, min(r.n_samples, r.start + 64 + 16))] and r.core == min(64, r.n_samples - r.start)


def test_bounds(spark, folder):
    with pytest.raises(InputError):
        C.chunk_clips(spark.range(1), 20_000_000, 0)
    with pytest.raises(Exception, match="no such file"):
        C.read_chunks(spark, folder + "/nowhere").count()
    head = C.WavHeader(b"RF64\xff\xff\xff\xffWAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, 6_000_000_000, 0, 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, SR, 2 * SR, 2, 16) + b"data\xff\xff\xff\xff", 6_000_000_100)
    assert head.n == 3_000_000_000 and head.width == 2
    frames = C.series_of_chunks(C.chunk_samples(spark.range(100).select(F.lit("a").alias("stimulus_id"), "id"), "id", "id", 10, 40, 20), lambda y: [dsp.frames(y, 4, 10).sum(axis=1)], ["s"], 10)
    assert [r.frame_idx for r in frames.orderBy("frame_idx").collect()] == list(range(11))
