"""Transcripts: nested decoder output to flat tables (TXT2-4, WIN9, FLT2, SCL5-8, AGG12-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ModelError
from ..functions.scalars import clean_verbatim_word, confidence, is_filler
from .grid import KEY
from .ordered import longest_run

MAX_RUN, RETRY_PENALTY = 6, 1.1
#: What a transcription provider yields per stimulus.
DECODED = (
    "stimulus_id string, segments array<struct<text:string,start:double,end:double,avg_logprob:double,no_speech_prob:double,"
    "words:array<struct<word:string,start:double,end:double,probability:double>>>>"
)


def check_verbatim(verbatim: bool, checkpoint: str | None, language: str | None) -> None:
    """TXT4."""
    if verbatim and checkpoint:
        raise ModelError("verbatim transcription has a checkpoint of its own")
    if verbatim and language not in (None, "en", "de"):
        raise ModelError("verbatim transcription knows English and German")


def check_rate(sr: int) -> None:
    """TXT1."""
    if sr != 16_000:
        raise ValueError("transcription takes 16 kHz audio")


def flatten(decoded: DataFrame, verbatim: bool = False, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(segments, words) of decoder output, segments numbered from 0 without gaps.

    Verbatim words are cleaned, empty ones dropped, segments without a word
    dropped with them, and the text rebuilt from the words that stay. A stimulus
    without speech has rows in neither table.
    """
    each = decoded.select(key, F.posexplode("segments").alias("_at", "s")).select(key, "_at", "s.*")
    if verbatim:
        cleaned = F.filter(F.transform("words", lambda w: F.struct(clean_verbatim_word(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("probability"))), lambda w: F.length(w["word"]) > 0)
        each = each.withColumn("words", cleaned).where(F.size("words") > 0).withColumn("text", F.array_join(F.transform("words", lambda w: w["word"]), " "))
    numbered = each.withColumn("segment_idx", F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1)
    segments = numbered.select(key, "segment_idx", F.trim("text").alias("text"), F.col("start").alias("onset"), F.col("end").alias("offset"), confidence(F.col("avg_logprob")).alias("asr_confidence"), "no_speech_prob")
    words = numbered.select(key, "segment_idx", F.posexplode("words").alias("_w", "w"))
    words = words.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("segment_idx", "_w")) - 1)
    flat = words.select(key, "segment_idx", "pos", F.trim("w.word").alias("word"), F.col("w.start").alias("onset"), F.col("w.end").alias("offset"), F.col("w.probability").alias("probability"))
    return segments, flat.withColumn("is_filler", is_filler(F.col("word"))) if verbatim else flat


def degenerate(words: DataFrame, limit: int = MAX_RUN, key: str = KEY) -> DataFrame:
    """TXT3: stimuli whose longest run of equal words exceeds ``limit``; they are decoded again."""
    return longest_run(words, "word", ["segment_idx", "pos"], key).where(F.col("max_run") > limit)


def retry(decoded: DataFrame, decode_again, limit: int = MAX_RUN, key: str = KEY) -> DataFrame:
    """TXT3: decoder output with degenerate stimuli replaced by ``decode_again(stimuli, penalty)``, and a flag."""
    bad = degenerate(flatten(decoded, key=key)[1], limit, key).select(key)
    kept = decoded.join(bad, key, "left_anti").withColumn("retried", F.lit(False))
    return kept.unionByName(decode_again(bad, RETRY_PENALTY).withColumn("retried", F.lit(True)))


def filler_summary(words: DataFrame, key: str = KEY) -> DataFrame:
    """AGG13."""
    return words.groupBy(key).agg(F.count("*").alias("n_words"), F.count_if("is_filler").alias("n_fillers"))
