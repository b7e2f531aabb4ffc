"""Word pools, score tables, sidecars and annotation matrices (SRC5-8, SRC10)."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError

#: Columns that are never numbers.
TEXT = ("stimulus_id", "word", "text", "speaker", "voice_gender", "matched_item")
KINDS = ("frames", "transcript", "transcript_words", "recall", "beats", "speakers")


def read_wordpool(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: (pool_index, item); blank lines and ``#`` lines are skipped, an empty pool is an error.

    The file is one experiment's list and is read as one text value, so line
    order is kept without a sort.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("_line", "raw"))
    kept = lines.select("_line", F.trim("raw").alias("item")).where("item <> '' and not startswith(item, '#')").collect()
    if not kept:
        raise ValueError(f"word pool {path} has no items")
    ordered = sorted(kept, key=lambda r: r._line)
    return spark.createDataFrame([(i, r.item) for i, r in enumerate(ordered)], "pool_index int, item string")


def resolve_scores(path: str) -> dict[str, str | None]:
    """SRC8: paths of every table of a result given its base, or any one of its tables."""
    base = re.sub(r"\.csv$", "", path)
    for kind in sorted(KINDS, key=len, reverse=True):
        if base.endswith("_" + kind):
            base = base[: -len(kind) - 1]
            break
    found = {kind: f"{base}_{kind}.csv" for kind in KINDS} | {"meta": f"{base}.meta.json"}
    return {kind: p if os.path.exists(p) else None for kind, p in found.items()}


def _read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with inferred numbers; identities and words stay text (``001`` is not 1)."""
    found = spark.read.csv(path, header=True, inferSchema=True)
    kinds = [f"`{f.name}` {'string' if f.name in TEXT else f.dataType.simpleString()}" for f in found.schema.fields]
    return spark.read.csv(path, header=True, schema=", ".join(kinds))


def read_scores(spark: SparkSession, path: str) -> dict[str, DataFrame | dict]:
    """SRC6-7: the tables of a result, and its sidecar; no table at all is an InputError."""
    paths = resolve_scores(path)
    tables: dict = {k: _read_table(spark, p) for k, p in paths.items() if p and k != "meta"}
    if not tables:
        raise InputError(f"no score tables for {path}")
    if paths["meta"]:
        with open(paths["meta"], encoding="utf-8") as f:
            tables["meta"] = json.load(f)
    return tables


def read_annotations(spark: SparkSession, path: str, song: str = "song_id") -> DataFrame:
    """SRC10: a wide matrix with ``…NNNms`` headers as (song_id, t, value)."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    timed = {c: int(m[1]) / 1000 for c in wide.columns if (m := re.search(r"(\d+)ms$", c))}
    long = wide.select(song, *[F.col(c).cast("double").alias(c) for c in timed]).unpivot([song], list(timed), "sample", "value")
    return long.select(song, (F.regexp_extract("sample", r"(\d+)ms$", 1).cast("double") / 1000).alias("t"), "value").where("value is not null")
