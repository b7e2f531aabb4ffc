"""Scalar functions (SCL1-16) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_AMPLITUDE = 1e-5
VOICE_BOUNDARY_HZ = 150.0
#: RMS 1.0 stands for 94 dB SPL re 20 µPa.
PASCAL_GAIN = 2e-5 * 10 ** (94 / 20)


def missing_if_nan(x: Column) -> Column:
    """NaN to NULL."""
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def finite(x: Column) -> Column:
    """NaN and ±inf to NULL."""
    x = missing_if_nan(x)
    return F.when(F.abs(x) < float("inf"), x)


def amplitude_to_db(x: Column) -> Column:
    """SCL1: 20·log10 with a floor of -100 dB; missing stays missing."""
    return F.when(x.isNotNull(), 20 * F.log10(F.greatest(x, F.lit(MIN_AMPLITUDE))))


def db_to_amplitude(db: Column) -> Column:
    """SCL2."""
    return F.pow(F.lit(10.0), db / 20)


def normalise_word(word: Column) -> Column:
    """SCL3: lower case, letters a-z and apostrophes only."""
    return F.regexp_replace(F.lower(word), "[^a-z']", "")


def clean_verbatim_word(word: Column) -> Column:
    """SCL5: strip what precedes the first word character or bracket, then blanks."""
    return F.trim(F.regexp_replace(word, r"(?U)^[^\w\[]+", ""))


def is_filler(word: Column) -> Column:
    """SCL6: bracketed token."""
    return word.rlike(r"^\[.+\]$")


def confidence(avg_logprob: Column) -> Column:
    """SCL8."""
    return F.exp(avg_logprob)


def voice_gender(median_f0: Column) -> Column:
    """SCL9: F from 150 Hz on, M below, empty if missing; judged before rounding."""
    return F.when(median_f0.isNull(), "").when(median_f0 >= VOICE_BOUNDARY_HZ, "F").otherwise("M")


def pascals(x: Column) -> Column:
    """SCL11."""
    return x * PASCAL_GAIN


def modulation_weight(f: Column) -> Column:
    """SCL12: 2 / (f/4 + 4/f), 0 at f = 0; 1 at 4 Hz."""
    return F.when(f > 0, 2 / (f / 4 + F.try_divide(F.lit(4.0), f))).otherwise(0.0)


def attack_decay(t: Column, attack: float, decay: float) -> Column:
    """SCL16: min(t/a, 1)·exp(-t/d)."""
    return F.least(t / attack, F.lit(1.0)) * F.exp(-t / decay)


def half_even(x: Column | str, digits: int) -> Column:
    """SCL10: rounding of ties to the even digit, on the decimal form of the number."""
    return F.bround(x, digits)


def json_number(x: Column) -> Column:
    """SCL14: non-finite to NULL, five decimals."""
    return F.round(finite(x), 5)


def html_escape(text: Column) -> Column:
    """SCL15."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
