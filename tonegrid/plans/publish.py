"""Publishing results with provenance (SNK1-7, SNK10)."""

from __future__ import annotations

import importlib.metadata
import json
import os
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from .. import __version__
from ..functions.vectors import flatten_columns
from ..operators.grid import KEY
from ..operators.summaries import column_pattern
from .score import ScoreResult

SCHEMA_VERSION = "1.0"
#: Packages that stand behind each provider model.
PACKAGES = {"clap": "transformers", "ebind_audio": "transformers", "speech": "silero-vad", "speech_emotion": "transformers", "egemaps": "opensmile", "psychoacoustic": "mosqito", "beats": "beat_this", "diarize": "pyannote.audio", "transcribe": "faster-whisper"}


@F.pandas_udf(StringType())
def six_digits(x: pd.Series) -> pd.Series:
    """SNK3: ``%.6g``; missing stays missing."""
    return x.map(lambda v: None if v is None or v != v else "%.6g" % v)


def with_identity(df: DataFrame, stimulus: str | None = None) -> DataFrame:
    """SNK2: the identity column first; an existing one is kept unless an override is given."""
    if stimulus is not None:
        df = df.withColumn(KEY, F.lit(stimulus))
    if KEY not in df.columns:
        raise ValueError("a table without stimulus_id needs an override")
    return df.select(KEY, *[c for c in df.columns if c != KEY])


def export_columns(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """EMB6, SNK3: vectors flattened to numbered columns, numbers in six digits."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType):
            size = (sizes or {}).get(f.name) or df.agg(F.max(F.size(f.name))).first()[0] or 0
            columns += flatten_columns(f.name, f.name, size)
        else:
            columns.append(F.col(f.name))
    flat = df.select(*columns)
    return flat.select(*[six_digits(F.col(f.name).cast("double")).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in flat.schema.fields])


def package_version(model: str) -> str:
    """SNK6."""
    try:
        return importlib.metadata.version(PACKAGES.get(model, model))
    except importlib.metadata.PackageNotFoundError:
        return __version__ if model not in PACKAGES else "unknown"


def _head(result: ScoreResult, source: dict, outputs: dict[str, dict]) -> dict:
    """What all documents of a run share."""
    models = {}
    for name, entry in result.meta.get("models", {}).items():
        plain = {k: v for k, v in entry.items() if not isinstance(v, DataFrame)}
        models[name] = {**plain, "version": package_version(name), "columns": column_pattern(entry["columns"]) or entry["columns"]}
    head = {"schema_version": SCHEMA_VERSION, "extractor": "tonegrid", "extractor_version": __version__, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "input": source, "models": models, "output": outputs}
    if result.frames is not None:
        head["frames"] = {"hop_sec": result.meta.get("hop"), "columns": result.frames.columns}
    return head


def documents(result: ScoreResult, source: dict | None = None, outputs: dict[str, dict] | None = None) -> DataFrame:
    """SNK5, CTX9, UDF2: (stimulus_id, document): the provenance of every stimulus as JSON.

    Beats, diarization, speech timing and recall, gate counts and what providers
    told about a clip are tables of one row per stimulus; they meet on the key,
    so a corpus of any size has its documents without the driver.
    """
    meta = result.meta
    blocks = {("beats", None): meta.get("beats"), ("diarization", None): meta.get("diarization"), ("transcription", "speech_timing"): meta.get("speech_timing"), ("transcription", "recall"): meta.get("recall")}
    blocks |= {("models", f"{name}/{kind}"): entry[kind] for name, entry in meta.get("models", {}).items() for kind in ("gates", "info") if isinstance(entry.get(kind), DataFrame)}
    blocks = {k: df for k, df in blocks.items() if isinstance(df, DataFrame)}
    every = [df.select(F.col(KEY).cast("string").alias(KEY)) for df in [*result.tables().values(), *blocks.values()] if KEY in df.columns]
    if not every:
        raise ValueError("a result without tables has no documents")
    keys = every[0]
    for more in every[1:]:
        keys = keys.unionAll(more)
    out, parts = keys.distinct(), []
    for n, ((block, inner), df) in enumerate(blocks.items()):
        rest = [c for c in df.columns if c != KEY]
        told = F.to_json(F.struct(*rest)) if rest != ["info"] else F.col("info")
        out = out.join(df.select(F.col(KEY).cast("string").alias(KEY), told.alias(f"_b{n}")), KEY, "left")
        parts.append((block, inner, f"_b{n}"))
    head = json.dumps(_head(result, source or {}, outputs or {}), default=str)
    names = [f"{block}|{inner or ''}" for block, inner, _ in parts]

    @F.pandas_udf(StringType())
    def whole(blocks: pd.DataFrame) -> pd.Series:
        """The shared head and a stimulus' own blocks as one JSON text."""
        found = []
        for row in blocks.itertuples(index=False):
            document = json.loads(head)
            for name, text in zip(names, row[1:], strict=True):
                if text is None:
                    continue
                block, _, inner = name.partition("|")
                value = json.loads(text)
                if block == "models":
                    document["models"][inner.split("/")[0]].update(value)
                elif inner:
                    document.setdefault(block, {})[inner] = value
                else:
                    document[block] = value
            found.append(json.dumps(document))
        return pd.Series(found)

    return out.select(KEY, whole(F.struct(KEY, *[c for _, _, c in parts])).alias("document"))


def sidecar(result: ScoreResult, source: dict, outputs: dict[str, dict]) -> dict:
    """SNK5: the provenance document of a clip; of several clips, one under ``stimuli`` for each."""
    found = {r[KEY]: json.loads(r.document) for r in documents(result, source, outputs).toLocalIterator()}
    if len(found) == 1:
        return next(iter(found.values()))
    return {**_head(result, source, outputs), "stimuli": found}


def write_tables(result: ScoreResult, folder: str, mode: str = "error") -> dict[str, dict]:
    """SNK1, SNK4: every table as Parquet, ranges of stimuli per file and sorted inside; row counts are observed during the write.

    A stimulus is read back by the statistics of its key, which stays a column
    with its own type; there is no folder per stimulus. Documents of provenance
    are a table of their own.
    """
    written = {}
    tables = result.tables()
    for kind, df in {**tables, "documents": documents(result)}.items() if tables else ():
        seen = Observation()
        path = f"{folder.rstrip('/')}/{kind}"
        order = [KEY, *[c for c in ("k", "segment_idx", "pos", "turn_idx", "time", "onset") if c in df.columns]]
        placed = with_identity(df).repartitionByRange(KEY).sortWithinPartitions(*order)
        placed.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
        written[kind] = {"path": path, "rows": seen.get["rows"]}
    return written


def write_csv(result: ScoreResult, base: str, source: dict | None = None, stimulus: str | None = None) -> dict:
    """SNK1-5: ``<base>_<kind>.csv`` for each table, and ``<base>.meta.json``: the exporter for single clips, whose tables fit the driver; corpora go to ``write_tables``."""
    base = base[:-4] if base.endswith(".csv") else base
    outputs = {}
    for kind, df in result.tables().items():
        order = [c for c in (KEY, "k", "segment_idx", "pos", "turn_idx", "time", "onset") if c in df.columns]
        rows = export_columns(with_identity(df, stimulus).orderBy(*order)).drop("k").toPandas()
        rows.to_csv(f"{base}_{kind}.csv", index=False)
        outputs[kind] = {"path": os.path.basename(f"{base}_{kind}.csv"), "rows": len(rows)}
    document = sidecar(result, source or {}, outputs)
    with open(f"{base}.meta.json", "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2, default=str)
    return document


def to_stdout(result: ScoreResult, stream) -> None:
    """SNK7: the first table there is, frames before transcript."""
    for df in result.tables().values():
        export_columns(with_identity(df)).toPandas().to_csv(stream, index=False)
        return
