import json
import os
import subprocess
import sys

import numpy as np
import pytest

from tonegrid import cli
from tonegrid.errors import ModelError
from tonegrid.explore import dashboard as D
from tonegrid.explore import projection as P
from tonegrid.operators.summaries import column_pattern, select_patterns
from tonegrid.plans import publish, registry
from tonegrid.plans.score import score
from tonegrid.providers.base import StubProvider
from tonegrid.sources import audio, files
from tonegrid.sources import synthetic as syn


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("clips")
    for name, y in (("a", syn.sine(220, 2)), ("b", syn.white_noise(2.6))):
        (folder / f"{name}.wav").write_bytes(audio.encode_wav(y, 22_050))
    return folder


def test_frames_of_a_corpus(spark, clips):
    frames = score(audio.read_stimuli(spark, str(clips)), ["spectral", "loudness", "clap"], providers={"clap": StubProvider(sr=48_000, window_sec=10.0)}).frames
    assert frames.columns[:4] == ["stimulus_id", "k", "time", "spectral_centroid"] and frames.columns[-1] == "clap"
    assert {(r.stimulus_id, r["count"]) for r in frames.groupBy("stimulus_id").count().collect()} == {("a", 4), ("b", 6)}
    assert all(np.linalg.norm(r.clap) == pytest.approx(1, abs=1e-5) for r in frames.collect())


def test_tables_and_sidecar(spark, clips, tmp_path):
    result = score(audio.read_stimuli(spark, str(clips / "a.wav")), ["loudness"])
    document = publish.write_csv(result, str(tmp_path / "out.csv"), {"path": "a.wav"})
    lines = (tmp_path / "out_frames.csv").read_text().splitlines()
    assert lines[0] == "stimulus_id,time,loudness_rms,loudness_db" and lines[1].startswith("a,0.25,0.346706,") and len(lines) == 5
    assert json.loads((tmp_path / "out.meta.json").read_text())["output"]["frames"]["rows"] == 4 == document["output"]["frames"]["rows"]
    assert publish.write_tables(result, str(tmp_path / "parts"))["frames"]["rows"] == 4
    tables = files.read_scores(spark, str(tmp_path / "out_frames.csv"))
    assert set(tables) == {"frames", "meta"}
    D.create_dashboard(str(tmp_path / "p.html"), "<t>", tables["frames"], meta=tables["meta"])
    page = (tmp_path / "p.html").read_text()
    assert "&lt;t&gt;" in page and "loudness_rms" in page


def test_provider_is_asked_for(spark, clips):
    with pytest.raises(ModelError, match="transcribe"):
        score(audio.read_stimuli(spark, str(clips)), ["transcribe"])
    with pytest.raises(ModelError, match="unknown"):
        registry.resolve(["nope"])


def test_registry_contract():
    assert len(registry.MODELS) == 18
    assert sum(m.window_sec is not None and m.name != "psychoacoustic" for m in registry.MODELS.values()) == 5
    assert [m.name for m in registry.detect(["time", "pitch_f0", "clap_000"])] == ["pitch", "clap"]


def test_names():
    assert select_patterns(["b_1", "a_1", "a_2"], ["a_*", "*_1"]) == ["a_1", "a_2", "b_1"]
    assert column_pattern([f"clap_{i:03d}" for i in range(512)]) == {"pattern": "clap_###", "range": [0, 511], "count": 512}
    assert column_pattern(["a_1"]) is None


def test_wordpool(spark, tmp_path):
    (tmp_path / "pool.txt").write_text("apple\n# comment\n\n banana \n")
    assert [(r.pool_index, r.item) for r in files.read_wordpool(spark, str(tmp_path / "pool.txt")).orderBy("pool_index").collect()] == [(0, "apple"), (1, "banana")]
    (tmp_path / "none.txt").write_text("# only\n")
    with pytest.raises(ValueError):
        files.read_wordpool(spark, str(tmp_path / "none.txt"))


def test_annotations(spark, tmp_path):
    (tmp_path / "v.csv").write_text("song_id,sample_15000ms,sample_15500ms\n2,0.5,\n")
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "v.csv")).collect()] == [(2, 15.0, 0.5)]


def test_projections(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(base)], "id int, a double, b double, c double, d double, e double")
    projected, ratio = P.pca(df, list("abcde"), 2)
    assert sum(ratio) == pytest.approx(1, abs=1e-6) and projected.count() == 60
    holes = df.selectExpr("id", "if(id % 7 = 0, null, a) as a", "b", "c", "d", "e")
    assert P.ppca(holes, list("abcde"), 2, 10)[0].where("size(projection) = 2").count() == 60
    y, stress = P.mds(base[:30], 2)
    far = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert np.corrcoef(far(y).ravel(), far(base[:30]).ravel())[0, 1] > 0.95
    assert list(P.isotonic(np.array([3.0, 1.0, 2.0]))) == [2.0, 2.0, 2.0]
    for bad in ("umap", "what"):
        with pytest.raises(ValueError):
            P.project(df, list("abcde"), bad)


def test_cli_rules(capsys):
    assert cli.main(["--list-models"]) == 0 and "loudness" in capsys.readouterr().out
    assert cli.main(["nope", "x.wav"]) == 1 and "unknown model" in capsys.readouterr().err
    assert cli.main(["loudness", "x.wav", "--wordpool", "p"]) == 1
    assert cli.main(["loudness", "missing.wav"]) == 1


def test_help_is_light():
    code = "import sys; from tonegrid import cli; cli.parser().format_help(); print(sorted(m for m in ('pyspark', 'numpy', 'pandas') if m in sys.modules))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=20)
    assert done.stdout.strip() == "[]"
