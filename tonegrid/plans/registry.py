"""Model registry and display configuration (CLI1, CTX10, VIZ11, SET3): no heavy import, so ``--help`` stays fast."""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatchcase

from ..errors import ModelError


@dataclass(frozen=True)
class Model:
    name: str
    level: str  # frame, events or segment
    description: str
    columns: tuple[str, ...] = ()
    sr: int = 22_050
    window_sec: float | None = None  # context that a grid row sees, where it is wider than the hop
    native: bool = True  # computed here; others need a provider
    maxes: tuple[str, ...] = ()  # reduced by maximum instead of mean
    kind: str = "series"  # of the dashboard
    top: int = 5
    detail: str | None = None
    family: str | None = None  # models of one family read one embedding pass
    gate: str | None = None  # silence, speech or loudness

    @property
    def provider(self) -> str:
        """The name under which a provider of this model is registered."""
        return self.family or self.name


def _names(prefix: str, count: int, width: int = 2) -> tuple[str, ...]:
    return tuple(f"{prefix}_{i:0{width}d}" for i in range(1, count + 1))


#: Low-level descriptor names of the acoustic-parameter provider, and our column names without prefix.
#: The last fifteen exist only in voiced frames.
VOICE_NAMES = {
    "Loudness_sma3": "loudness",
    "alphaRatio_sma3": "alpha_ratio",
    "hammarbergIndex_sma3": "hammarberg",
    "slope0-500_sma3": "slope_0_500",
    "slope500-1500_sma3": "slope_500_1500",
    "spectralFlux_sma3": "flux",
    "mfcc1_sma3": "mfcc1",
    "mfcc2_sma3": "mfcc2",
    "mfcc3_sma3": "mfcc3",
    "mfcc4_sma3": "mfcc4",
    "F0semitoneFrom27.5Hz_sma3nz": "f0_semitone",
    "jitterLocal_sma3nz": "jitter",
    "shimmerLocaldB_sma3nz": "shimmer",
    "HNRdBACF_sma3nz": "hnr",
    "logRelF0-H1-H2_sma3nz": "h1_h2",
    "logRelF0-H1-A3_sma3nz": "h1_a3",
    "F1frequency_sma3nz": "f1_freq",
    "F1bandwidth_sma3nz": "f1_bw",
    "F1amplitudeLogRelF0_sma3nz": "f1_amp",
    "F2frequency_sma3nz": "f2_freq",
    "F2bandwidth_sma3nz": "f2_bw",
    "F2amplitudeLogRelF0_sma3nz": "f2_amp",
    "F3frequency_sma3nz": "f3_freq",
    "F3bandwidth_sma3nz": "f3_bw",
    "F3amplitudeLogRelF0_sma3nz": "f3_amp",
}
VOICE_PARAMETERS = tuple(VOICE_NAMES.values())
#: Categories of the sound-event bank and the prompts whose embeddings are averaged for each.
PROMPTS = {
    "speech": ("a person speaking", "people having a conversation", "someone talking"),
    "music": ("music playing", "an instrumental piece of music", "background music"),
    "singing": ("a person singing", "a singing voice", "a vocal melody"),
    "laughter": ("a person laughing", "laughter", "people laughing together"),
    "crying": ("a person crying", "sobbing and weeping", "a baby crying"),
    "shouting": ("a person shouting", "someone yelling angrily", "a person screaming"),
    "crowd": ("a crowd of people", "the murmur of a busy crowd", "many people talking at once"),
    "applause": ("an audience applauding", "clapping and applause", "people clapping their hands"),
    "footsteps": ("footsteps", "the sound of someone walking", "footsteps on a hard floor"),
    "vehicle": ("a car engine running", "traffic noise", "a vehicle driving past"),
    "water": ("rain falling", "water flowing", "a running stream of water"),
    "wind": ("wind blowing", "wind howling", "a gust of wind"),
    "animals": ("a dog barking", "birds chirping", "animal sounds"),
    "gunshot_explosion": ("a gunshot", "gunfire", "an explosion"),
    "siren_alarm": ("a siren wailing", "an emergency vehicle siren", "an alarm ringing"),
    "thunder": ("thunder rumbling", "a thunderstorm", "a thunder clap"),
}
SOUND_EVENTS = tuple(PROMPTS)

MODELS = {
    m.name: m
    for m in (
        Model("loudness", "frame", "RMS energy and level in dB", ("loudness_rms", "loudness_db")),
        Model("pitch", "frame", "fundamental frequency and voicing", ("pitch_f0", "pitch_voiced_prob")),
        Model("spectral", "frame", "spectral moments, flux and zero crossings", ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flux", "spectral_zcr")),
        Model("onsets", "frame", "onset strength, rate and tempo", ("onsets_strength", "onsets_rate", "onsets_tempo")),
        Model("tonal", "frame", "key clarity, mode and chroma entropy", ("tonal_key_clarity", "tonal_majorness", "tonal_chroma_entropy")),
        Model("rhythm", "frame", "pulse clarity, beat strength and novelty", ("rhythm_pulse_clarity", "rhythm_beat_strength", "rhythm_novelty"), maxes=("rhythm_beat_strength",)),
        Model("timbre", "frame", "cepstral coefficients, contrast and flatness", (*_names("timbre_mfcc", 13), *_names("timbre_contrast", 7), "timbre_flatness"), top=8),
        Model("psychoacoustic", "frame", "loudness, sharpness, roughness and fluctuation", tuple(f"psychoacoustic_{x}" for x in ("loudness", "sharpness", "roughness", "fluctuation")), 48_000, 2.0, False, gate="loudness"),
        Model("speech", "frame", "speech probability", ("speech_prob",), 16_000, None, False, detail="bars_prob"),
        Model("clap", "frame", "general audio embedding", ("clap",), 48_000, 10.0, False, kind="embedding", top=8, family="clap"),
        Model("ebind_audio", "frame", "multimodal audio embedding", ("ebind_audio",), 16_000, 2.0, False, kind="embedding", top=8),
        Model("music_emotion", "frame", "valence and arousal of music", ("music_emotion_valence", "music_emotion_arousal"), 48_000, 10.0, False, family="clap", gate="silence"),
        Model("sound_events", "frame", "cosine to sound categories", tuple(f"sound_events_{c}" for c in SOUND_EVENTS), 48_000, 10.0, False, top=8, detail="bars_sorted", family="clap", gate="silence"),
        Model("speech_emotion", "frame", "valence, arousal and dominance of speech", tuple(f"speech_emotion_{x}" for x in ("valence", "arousal", "dominance")), 16_000, 4.0, False, detail="bars_norm", gate="speech"),
        Model("egemaps", "frame", "acoustic voice parameters", tuple(f"egemaps_{x}" for x in VOICE_PARAMETERS), 16_000, None, False, top=8, detail="bars_norm", gate="speech"),
        Model("beats", "events", "beats and downbeats", ("time", "is_downbeat"), native=False),
        Model("diarize", "events", "speaker turns", ("turn_idx", "speaker", "onset", "offset"), 16_000, None, False),
        Model("transcribe", "segment", "segments and words", ("segment_idx", "text", "onset", "offset", "asr_confidence", "no_speech_prob"), 16_000, None, False),
    )
}


def resolve(names: list[str]) -> list[Model]:
    """Models in request order, each once; unknown names are a ModelError."""
    unknown = [n for n in names if n not in MODELS]
    if unknown:
        raise ModelError(f"unknown model {', '.join(unknown)}; known: {', '.join(MODELS)}")
    return [MODELS[n] for n in dict.fromkeys(names)]


def detect(columns: list[str], level: str | None = None) -> list[Model]:
    """PRJ2: models whose columns (or numbered vector columns) occur among ``columns``."""
    hit = lambda m: any(c in columns for c in m.columns) or any(fnmatchcase(c, f"{m.name}_[0-9]*") for c in columns)
    return [m for m in MODELS.values() if (level is None or m.level == level) and m.level != "events" and hit(m)]
