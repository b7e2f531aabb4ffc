"""The dashboard's payload and page."""

import json
import math
import re

import pytest

from tonegrid.explore import dashboard as D
from tonegrid.explore import projection as P


def frames(spark, n=40):
    rows = [(0.5 * i + 0.25, math.sin(i / 3), math.cos(i / 5) * 10, float(i % 4), None if i % 7 == 0 else 100.0 + i) for i in range(n)]
    return spark.createDataFrame(rows, "time double, onsets_strength double, onsets_rate double, onsets_tempo double, pitch_f0 double")


def test_trajectory_follows_time(spark):
    data = D.payload(frames(spark))
    onsets = next(m for m in data["models"] if m["name"] == "onsets")
    assert onsets["projection"]["method"] == "mds" and onsets["trajectory"]["method"] == "pca"
    assert onsets["trajectory"]["times"] == sorted(onsets["trajectory"]["times"]) and len(onsets["trajectory"]["points"]) == 40
    assert len(onsets["trajectory"]["explained"]) == 3 and data["hop"] == 0.5
    pitch = next(m for m in data["models"] if m["name"] == "pitch")
    assert "projection" not in pitch and data["tables"]["frames"]["data"]["pitch_f0"][0] is None


def test_page_holds_its_payload(spark):
    data = D.payload(frames(spark, 6))
    page = D.render(data, "a <b>")
    held = json.loads(re.search(r'id="data">(.*?)</script>', page, re.S)[1])
    assert held == json.loads(json.dumps(data)) and "a &lt;b&gt;" in page and "ArrowRight" in page and 'id="smooth"' in page
    assert D.audio_uri(b"RIFF").startswith("data:audio/")


def test_detail_panels(spark):
    rows = [(0.25, *[0.1 * i for i in range(16)])]
    from tonegrid.plans.registry import MODELS

    columns = MODELS["sound_events"].columns
    df = spark.createDataFrame(rows, "time double, " + ", ".join(f"{c} double" for c in columns))
    entry = D.payload(df)["models"][0]
    assert entry["detail"] == "bars_sorted" and entry["detail_label"] == "largest first" and "projection" not in entry


def test_optional_projections_say_what_they_need(spark):
    with pytest.raises(ValueError, match="not installed"):
        P.project(frames(spark), ["onsets_strength", "onsets_rate"], "tsne")
    with pytest.raises(ValueError, match="at least 2"):
        P.project(frames(spark), ["onsets_rate"], "umap")
