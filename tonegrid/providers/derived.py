"""Models that read provider output: gates and read-outs in plain DataFrame algebra (FRM10, FRM12, FRM15-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import missing_if_nan
from ..operators import context as C
from ..operators import embeddings as E
from ..operators import grid as G
from ..operators.grid import KEY
from ..plans.registry import PROMPTS, VOICE_NAMES, VOICE_PARAMETERS

#: Voice parameters that exist only in voiced frames (``nz`` of the descriptor's name): an exact zero there means "not measured", and speech gates them.
VOICED = tuple(ours for theirs, ours in VOICE_NAMES.items() if theirs.endswith("nz"))


def prompt_table(spark: SparkSession) -> DataFrame:
    """(category, prompt): what a text-embedding provider embeds before ``ensemble_bank`` averages it."""
    return spark.createDataFrame([(c, p) for c, prompts in PROMPTS.items() for p in prompts], "category string, prompt string")


def gated_embeddings(embeddings: DataFrame, native: DataFrame, durations: DataFrame, hop: float, width: float, value: str = "sample", dbfs: float = C.SILENCE_DBFS) -> DataFrame:
    """CTX3: clip vectors with ``silent`` marked from the RMS of their own context."""
    stats = C.context_stats(native, G.spine(durations, hop), durations, width, value)
    marked = stats.select(KEY, "k", C.is_silent(F.col("context_rms"), dbfs).alias("silent"))
    return embeddings.join(marked, [KEY, "k"], "left").withColumn("silent", F.coalesce("silent", F.lit(True)))


def silence_marked(embeddings: DataFrame, dbfs: float = C.SILENCE_DBFS) -> DataFrame:
    """CTX3 for vectors that carry the level of their own context."""
    return embeddings.withColumn("silent", C.is_silent(F.col("context_rms"), dbfs))


def read_probe(path: str) -> dict[str, tuple[list[float], float]]:
    """SRC9: linear read-outs from a user's JSON file, ``{name: {"coef": […], "intercept": b}}``."""
    import json

    with open(path, encoding="utf-8") as f:
        return {name: ([float(x) for x in p["coef"]], float(p["intercept"])) for name, p in json.load(f).items()}


def prompt_bank(spark: SparkSession, model) -> DataFrame:
    """EMB2: (category, bank vector) from the provider's vectors of the fixed prompts."""
    pairs = [(c, p) for c, prompts in PROMPTS.items() for p in prompts]
    vectors = model.texts([p for _, p in pairs])
    table = spark.createDataFrame([(c, [float(x) for x in v]) for (c, _), v in zip(pairs, vectors, strict=True)], "category string, embedding array<double>")
    return E.ensemble_bank(table, "category", "embedding")


def music_emotion(embeddings: DataFrame, probe: dict[str, tuple[list[float], float]], vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """FRM15: clipped linear read-outs; silent windows are missing. ``keep``: columns to carry along."""
    out = E.linear_probe(embeddings, vector, {f"music_emotion_{k}": v for k, v in probe.items()})
    return out.select(KEY, "k", *keep, *[C.gate(F.col(f"music_emotion_{k}"), ~F.col("silent")).alias(f"music_emotion_{k}") for k in probe])


def sound_events(embeddings: DataFrame, bank: DataFrame, names: list[str], vector: str = "embedding") -> DataFrame:
    """FRM16: raw cosines in one column per category; silent windows are missing."""
    scores = E.cosine_bank(embeddings.select(KEY, "k", "silent", vector), bank, vector)
    scores = scores.withColumn("score", C.gate(F.col("score"), ~F.col("silent")))
    return E.pivot_scores(scores, [KEY, "k"], "category", names, prefix="sound_events_")


def speech_fraction(vad: DataFrame, spine: DataFrame, durations: DataFrame, width: float) -> DataFrame:
    """CTX4: mean speech probability of every context; 0 where there is no block."""
    stats = C.context_stats(vad, spine, durations, width, "prob")
    return stats.select(KEY, "k", F.coalesce("context_mean", F.lit(0.0)).alias("speech_fraction"))


def speech_probability(vad: DataFrame, durations: DataFrame, hop: float) -> DataFrame:
    """FRM12: block probabilities on the grid."""
    return G.to_grid(vad, durations, hop, means=("prob",)).withColumnRenamed("prob_mean", "speech_prob")


def speech_emotion(raw: DataFrame, fractions: DataFrame) -> DataFrame:
    """FRM17, CTX5: provider order is arousal, dominance, valence; all three are gated by speech."""
    joined = raw.join(fractions, [KEY, "k"])
    order = (("valence", 2), ("arousal", 0), ("dominance", 1))
    return joined.select(KEY, "k", *[C.speech_gate(F.col("outputs")[i], F.col("speech_fraction")).alias(f"speech_emotion_{n}") for n, i in order])


def voice_parameters(native: DataFrame, fractions: DataFrame, durations: DataFrame, hop: float, names: dict[str, str] | None = None) -> DataFrame:
    """FRM18, PRJ5, CTX6, CTX8: provider columns renamed, zeros and NaN missing, averaged, voiced ones gated."""
    renamed = native.withColumnsRenamed(VOICE_NAMES | (names or {}))
    present = [p for p in VOICE_PARAMETERS if p in renamed.columns]
    clean = renamed.select(KEY, "t", *[(C.zero_is_missing(missing_if_nan(F.col(p))) if p in VOICED else missing_if_nan(F.col(p))).alias(p) for p in present])
    grid = G.to_grid(clean, durations, hop, means=tuple(present)).join(fractions, [KEY, "k"])
    value = lambda p: C.speech_gate(F.col(f"{p}_mean"), F.col("speech_fraction")) if p in VOICED else F.col(f"{p}_mean")
    return grid.select(KEY, "k", *[value(p).alias(f"egemaps_{p}") for p in present])


def psychoacoustic(native: DataFrame, durations: DataFrame, hop: float) -> DataFrame:
    """FRM10, CTX7: provider series on the grid; sharpness needs 0.25 sone of loudness."""
    grid = G.to_grid(native, durations, hop, means=("loudness", "sharpness", "roughness", "fluctuation"))
    return grid.select(
        KEY, "k", F.col("loudness_mean").alias("psychoacoustic_loudness"), C.sharpness_gate(F.col("sharpness_mean"), F.col("loudness_mean")).alias("psychoacoustic_sharpness"),
        F.col("roughness_mean").alias("psychoacoustic_roughness"), F.col("fluctuation_mean").alias("psychoacoustic_fluctuation"),
    )
