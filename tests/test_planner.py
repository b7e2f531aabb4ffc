"""Provider-fed models through the planner: shared passes, gates, documents, flags."""

import json
import sys
import types
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark import cloudpickle

from tonegrid import cli
from tonegrid.errors import ModelError
from tonegrid.operators import embeddings as E
from tonegrid.operators import recall as R
from tonegrid.plans import publish
from tonegrid.plans.registry import SOUND_EVENTS, VOICE_NAMES
from tonegrid.plans.score import score
from tonegrid.providers import base, derived
from tonegrid.sources import audio
from tonegrid.sources import synthetic as syn

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module
PROBE = {"valence": ([0.1] * 8, -0.1), "arousal": ([0.2] * 8, 0.0)}


@dataclass
class Series:
    """A constant series at 100 values a second."""

    columns: tuple
    values: tuple
    sr: int = 16_000

    @staticmethod
    def available():
        return True

    def load(self):
        pass

    def clip(self, y, sr):
        t = np.arange(0, len(y) / sr, 0.01)
        return {"t": t, **{c: np.full(len(t), v) for c, v in zip(self.columns, self.values, strict=True)}}


@dataclass
class Emotion(base.StubProvider):
    window_sec: float = 4.0

    def run(self, windows):
        return np.array([[0.1, 0.2, 0.3]] * len(windows))


@dataclass
class Speaker:
    """One segment per clip; a degenerate one unless it is penalised."""

    checkpoint: str = "base"
    language: str | None = None
    verbatim: bool = False
    penalty: float = 0.0
    sr: int = 16_000
    schema: str = "segments array<struct<text:string,start:double,end:double,avg_logprob:double,no_speech_prob:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>"

    @staticmethod
    def available():
        return True

    def load(self):
        pass

    def penalised(self, penalty):
        return Speaker(self.checkpoint, self.language, self.verbatim, penalty)

    def clip(self, y, sr):
        said = ["apple", "banana", self.checkpoint] if self.penalty else ["loop"] * 9
        words = [{"word": w, "start": 0.2 * i, "end": 0.2 * i + 0.1, "probability": 0.9} for i, w in enumerate(said)]
        return [{"segments": [{"text": " ".join(said), "start": 0.0, "end": 1.5, "avg_logprob": 0.0, "no_speech_prob": 0.1, "words": words}]}]


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("provider_clips")
    loud = syn.sine(220, 6)
    loud[: 22_050 * 3] = 0
    for name, y in (("half", loud), ("quiet", np.zeros(22_050 * 2, dtype=np.float32))):
        (folder / f"{name}.wav").write_bytes(audio.encode_wav(y, 22_050))
    return folder


def clap():
    return base.StubProvider(sr=8_000, window_sec=2.0)


def test_a_family_is_embedded_once(spark, clips):
    stimuli = audio.read_stimuli(spark, str(clips))
    names = ["clap", "music_emotion", "sound_events"]
    whole = score(stimuli, names, providers={"clap": clap()}, probe=PROBE)
    assert len(whole.held) == 3  # the grid's waveform, the provider's waveform, one embedding pass
    assert whole.frames.columns == ["stimulus_id", "k", "time", "clap", "music_emotion_valence", "music_emotion_arousal", *(f"sound_events_{c}" for c in SOUND_EVENTS)]
    backwards = score(stimuli, names[::-1], providers={"clap": clap()}, probe=PROBE)
    alone = score(stimuli, ["sound_events"], providers={"clap": clap()})
    row = lambda r: (r.stimulus_id, r.k, r.sound_events_music, r.sound_events_speech)
    first = sorted(map(row, whole.frames.collect()))
    assert first == sorted(map(row, backwards.frames.collect())) == sorted(map(row, alone.frames.collect()))
    rows = {(r.stimulus_id, r.k): r for r in whole.frames.collect()}
    assert all(rows["quiet", k].music_emotion_valence is None and rows["quiet", k].sound_events_music is None and rows["quiet", k].clap is not None for k in range(4))
    assert rows["half", 0].music_emotion_valence is None and rows["half", 11].music_emotion_valence == pytest.approx(0.1 * sum(rows["half", 11].clap) - 0.1, abs=1e-6)
    counts = {r.stimulus_id: r.n_windows_silence_gated for r in whole.meta["models"]["music_emotion"]["gates"].collect()}
    assert counts["quiet"] == 4 and 0 < counts["half"] < 12
    whole.release()
    assert not whole.held


def test_speech_gates(spark, clips):
    voice = Series(tuple(VOICE_NAMES), tuple(float(i) for i in range(len(VOICE_NAMES))))
    providers = {"speech": base.StubSpeech(), "speech_emotion": Emotion(), "egemaps": voice, "psychoacoustic": Series(("loudness", "sharpness", "roughness", "fluctuation"), (0.2, 1.0, 2.0, 3.0))}
    result = score(audio.read_stimuli(spark, str(clips)), ["speech", "speech_emotion", "egemaps", "psychoacoustic"], providers=providers)
    rows = {(r.stimulus_id, r.k): r for r in result.frames.collect()}
    assert rows["quiet", 0].speech_prob == 0 and rows["half", 11].speech_prob == 1
    assert rows["quiet", 0].speech_emotion_valence is None
    assert tuple(round(rows["half", 11][f"speech_emotion_{x}"], 6) for x in ("valence", "arousal", "dominance")) == (0.3, 0.1, 0.2)
    assert rows["quiet", 0].egemaps_f0_semitone is None and rows["quiet", 0].egemaps_loudness == 0 and rows["half", 11].egemaps_f0_semitone == 10
    assert rows["half", 11].psychoacoustic_sharpness is None and rows["half", 11].psychoacoustic_roughness == 2
    assert derived.VOICED[0] == "f0_semitone" and len(derived.VOICED) == 15
    gates = {name: {r.stimulus_id: r[1] for r in result.meta["models"][name]["gates"].collect()} for name in ("speech_emotion", "egemaps", "psychoacoustic")}
    assert gates["egemaps"]["quiet"] == 4 and gates["psychoacoustic"] == {"half": 12, "quiet": 4}


def test_segments_turns_and_documents(spark, clips, tmp_path):
    pool = spark.createDataFrame([(0, "apple"), (1, "cherry")], "pool_index int, item string")
    providers = {"transcribe": Speaker("cherri"), "diarize": base.StubTurns(num_speakers=3)}
    result = score(audio.read_stimuli(spark, str(clips)), ["loudness", "diarize", "transcribe"], wordpool=pool, providers=providers)
    assert {r.text for r in result.transcript.collect()} == {"apple banana cherri"}  # decoded again with the penalty
    assert [(r.speaker, r.onset, r.offset) for r in result.speakers.collect()] == [("S0", 3.0, 6.0)]
    assert sorted((r.stimulus_id, r.word, r.pool_index) for r in result.recall.collect())[:3] == [("half", "apple", 0), ("half", "banana", -1), ("half", "cherri", 1)]
    documents = {r.stimulus_id: json.loads(r.document) for r in publish.documents(result, {"path": "x"}).collect()}
    half = documents["half"]
    assert half["diarization"] == {"n_speakers": 1, "n_turns": 1, "speaker_seconds": {"S0": 3.0}}
    assert half["transcription"]["recall"]["n_recalled"] == 2 and half["transcription"]["speech_timing"]["n_words"] == 3
    assert half["models"]["diarize"]["speaker_hint"] == 3 and half["input"] == {"path": "x"} and "diarization" not in documents["quiet"]
    written = publish.write_tables(result, str(tmp_path / "out"))
    assert written["documents"]["rows"] == 2 and written["frames"]["rows"] == 16
    back = spark.read.parquet(written["frames"]["path"])
    assert dict(back.dtypes)["stimulus_id"] == "string" and back.count() == 16
    assert publish.write_csv(result, str(tmp_path / "two"))["stimuli"].keys() == {"half", "quiet"}


def test_identities_stay_text(spark, tmp_path):
    from tonegrid.plans.score import ScoreResult
    from tonegrid.sources.files import read_scores

    frames = spark.createDataFrame([("001", 0, 0.25, 1.5)], "stimulus_id string, k int, time double, loudness_rms double")
    written = publish.write_tables(ScoreResult(frames=frames), str(tmp_path / "out"))
    assert spark.read.parquet(written["frames"]["path"]).first().stimulus_id == "001"
    publish.write_csv(ScoreResult(frames=frames), str(tmp_path / "one.csv"))
    assert read_scores(spark, str(tmp_path / "one.csv"))["frames"].first().stimulus_id == "001"


def test_missing_parts_are_named(spark, clips):
    stimuli = audio.read_stimuli(spark, str(clips))
    with pytest.raises(ModelError, match="speech .for speech_emotion"):
        score(stimuli, ["speech_emotion"], providers={"speech_emotion": Emotion()})
    with pytest.raises(ModelError, match="probe"):
        score(stimuli, ["music_emotion"], providers={"clap": clap()})


def test_flags_reach_the_providers(clips, tmp_path, monkeypatch, capsys, spark):
    seen = {}

    class Told(Speaker):
        def __init__(self, **options):
            seen.update(options)
            super().__init__(**options)

    monkeypatch.setattr(base, "_REGISTRY", dict(base._REGISTRY))
    monkeypatch.setitem(sys.modules, "my_providers", types.ModuleType("my_providers"))
    base.register("transcribe", Told)
    base.register("diarize", base.StubTurns)
    path = str(clips / "half.wav")
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["diarize", "transcribe", path, "-o", str(tmp_path / "o"), "--language", "de", "--asr-model", "tiny", "--num-speakers", "4", "--providers", "my_providers"]) == 0
    assert seen == {"checkpoint": "tiny", "language": "de"}
    meta = json.loads((tmp_path / "o.meta.json").read_text())
    assert meta["models"]["diarize"]["speaker_hint"] == 4 and (tmp_path / "o_transcript_words.csv").exists()
    can, left = cli.runnable(base, None)
    assert {"loudness", "transcribe", "diarize"} <= {*can} and {"clap", "music_emotion", "beats"} <= {*left}
    assert cli.main(["--all", "loudness", path]) == 1
    assert cli.main(["loudness", str(clips), "-o", str(tmp_path / "corpus")]) == 0  # a folder is a corpus
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    assert cli.main(["loudness", str(tmp_path / "bad.wav")]) == 1 and "Traceback" not in capsys.readouterr().err


def test_input_kinds(tmp_path):
    (tmp_path / "a.webm").write_bytes(b"")
    assert audio.input_type(str(tmp_path / "a.webm")) == "video" and audio.input_type(str(tmp_path)) == "folder"
    from tonegrid.errors import InputError

    (tmp_path / "a.avi").write_bytes(b"")
    with pytest.raises(InputError, match="webm"):
        audio.input_type(str(tmp_path / "a.avi"))


def test_blocks_of_banks_and_pools(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(6)], "id int, embedding array<double>")
    bank = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(7)], "category string, bank array<double>")
    whole = sorted((r.id, r.category, r.score) for r in E.cosine_bank(vectors, bank).collect())
    monkeypatch.setattr(E, "MAX_BANK_ROWS", 3)
    assert sorted((r.id, r.category, r.score) for r in E.cosine_bank(vectors, bank).collect()) == whole
    words = spark.createDataFrame([(w,) for w in ("bananna", "aple", "zzz", "cherri")], "norm string")
    pool = R.pool_table(spark.createDataFrame([(i, w) for i, w in enumerate(["apple", "banana", "cherry", "banane", "maple"])], "pool_index int, item string"))
    one = sorted(tuple(r) for r in R.best_fuzzy(words, pool).collect())
    monkeypatch.setattr(R, "MAX_POOL", 2)
    assert sorted(tuple(r) for r in R.best_fuzzy(words, pool).collect()) == one
