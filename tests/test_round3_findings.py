"""What a review of larger tables found: batches of table functions, samples in shuffles, contexts of long recordings."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid import queries as Q
from tonegrid.operators import context, grid
from tonegrid.errors import InputError
from tonegrid.providers import tables
from tonegrid.providers.base import StubProvider, StubTurns, embed_chunks
from tonegrid.sources import chunks as C


def test_table_functions_take_bounded_batches(spark):
    """a batch of 10 000 clips was Python numbers at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        tables.register_provider(spark, "bounded_turns", StubTurns(sr=100))
        assert int(spark.conf.get(name)) == tables.BATCH_BYTES
        spark.conf.set(name, "1m")
        tables.register_provider(spark, "bounded_turns", StubTurns(sr=100))
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_runs_make_the_chunks_of_their_samples(spark):
    runs = spark.createDataFrame([(k, r, float(r * r % 7)) for k, n in (("a", 23), ("b", 1), ("c", 8)) for r in range(n)], "stimulus_id string, e long, x double")
    samples = runs.select("stimulus_id", F.explode(F.sequence(F.col("e") * 5, F.col("e") * 5 + 4)).alias("i"), "x")
    order = ["stimulus_id", "chunk"]
    got, want = C.chunk_runs(runs, "e", "x", 5, 100, 40, 15), C.chunk_samples(samples, "i", "x", 100, 40, 15)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.orderBy(*order).collect() == want.orderBy(*order).collect()
    with pytest.raises(InputError):
        C.chunk_runs(runs, "e", "x", 5, 100, 42, 15)


def test_levels_are_shuffled_by_event(spark):
    """F8, F9: fifty samples an event went through the shuffle."""
    sf = "/root/testdata/sf0.001"
    assert Q._levels(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("n", [1, 7, 150, 199, 200, 201, 5_003])
@pytest.mark.parametrize("core", [60, 1000])
def test_contexts_of_a_chunk_are_those_of_all(spark, n, core):
    y = np.arange(n, dtype=np.float32)
    rows = [("a", 100, n, c, s, min(s, 300), min(core, n - s), y[max(s - 300, 0) : s + core + 300].tolist()) for c, s in enumerate(range(0, n, core))]
    df = spark.createDataFrame(rows, C.SCHEMA)
    got = embed_chunks(df, StubProvider(sr=100, window_sec=2.0), 0.5).orderBy("k").collect()
    assert [r.k for r in got] == list(range(max(1, -(-n // 50))))
    for r in got:
        start = int(min(max((r.k + 0.5) * 0.5 - 1, 0.0), max(n / 100 - 2, 0.0)) * 100)
        own = y[start : start + 200].astype(float)
        parts = np.array([np.sqrt(np.mean(p**2)) if len(p) else 0.0 for p in np.array_split(own, 8)])
        assert np.allclose(r.embedding, parts / (np.linalg.norm(parts) or 1), atol=1e-6) and r.context_rms == pytest.approx(np.sqrt(np.mean(own**2)))


def test_gated_run_embeds_once(spark):
    """F8: the count of gated windows was a second embedding pass."""
    plan = Q.gated_provider_run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_context_sums_do_not_carry_what_went_before(spark):
    """a context's mean at the gate's threshold came out under it after other values of its bucket."""
    rows = [("a", 0.1 + 0.01 * j, 0.1 * j + 0.37) for j in range(90)] + [("a", 2.5, 125.0), ("a", 3.5, 110.37), ("a", 3.6, 139.63), ("a", 5.2, None), ("a", 6.1, 3e20)]
    native = spark.createDataFrame(rows, "stimulus_id string, t double, v double")
    durations = spark.createDataFrame([("a", 8.0)], "stimulus_id string, duration double")
    got = {r.k: r for r in context.context_stats(native, grid.spine(durations, 1.0), durations, 1.0, "v").collect()}
    assert got[2].context_mean == got[3].context_mean == got[2].context_rms == 125.0 and got[3].n_values == 2
    assert got[5].context_mean is None and got[5].n_values == 0 and got[6].context_mean == 3e20
    wide = {r.k: r for r in context.context_stats(native, grid.spine(durations, 1.0), durations, 4.0, "v").collect()}
    assert wide[3].context_mean == 125.0 and wide[3].n_values == 3


def test_assembled_grids_keep_their_partitions(spark):
    """the joins of all families, with their sorts, ran in one task, as grids are few bytes."""
    durations = spark.range(40).selectExpr("id as stimulus_id", "50D as duration")
    spine = grid.spine(durations, 1.0)
    frames = grid.assemble(spine, [spine.selectExpr("stimulus_id", "k", "time", "k * 2 as a"), spine.where("k < 9").selectExpr("stimulus_id", "k", "time", "k as b")])
    assert frames.columns == ["stimulus_id", "k", "time", "a", "b"] and frames.count() == 2000 and frames.where("a = 2 * k and (b is null) = (k >= 9)").count() == 2000
    assert frames.select("k", "b").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_timed_replay_is_written_by_all_tasks(spark, monkeypatch):
    """every part of the stream was computed anew and written by one task; the last row still comes last."""
    folders, own = [], Q.scratch
    monkeypatch.setattr(Q, "scratch", lambda s: folders.append(own(s)) or folders[-1])
    Q.timed_pauses_replay(spark, "/root/testdata/sf0.001").count()
    said = Q.words(spark, "/root/testdata/sf0.001").count()
    parts = [spark.read.parquet(f"{folders[0]}/in/{i}") for i in range(4)]
    assert sum(p.count() for p in parts) == said and all(len(p.inputFiles()) > 1 for p in parts)


def test_clips_together_are_clips_alone():
    """every clip of a few frames was a call of every kernel."""
    from tonegrid.kernels import dsp
    from tonegrid.plans import score

    rng = np.random.default_rng(4)
    tones = lambda n: np.concatenate([0.4 * np.sin(2 * np.pi * f * np.arange(441) / dsp.SR) for f in rng.uniform(80, 900, n)])
    ys = [tones(int(n)).astype(np.float32) for n in rng.integers(1, 30, 20)] + [np.zeros(0, np.float32), np.zeros(3000, np.float32), rng.normal(size=9000).astype(np.float32)]
    names = ["loudness", "pitch", "spectral", "onsets", "tonal", "rhythm", "timbre"]
    starts, times, series = score._layers(ys, names)
    for y, (a, b) in zip(ys, dsp.clips(starts, len(times)), strict=True):
        t, alone = score._layer(y, names)
        assert np.array_equal(t, times[a:b])
        for name, values in alone.items():
            assert np.allclose(values, series[name][a:b], rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_scene_clips_are_made_once_by_all_tasks(spark):
    """durations were sizes of samples, made anew for them, and the clips of few bytes of events were one or two tasks."""
    plan = Q.scene_frames(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") == 0 and plan.count("MapInArrow") == 2 and "RepartitionByExpression" in plan


def test_training_is_left_to_a_task(spark, monkeypatch):
    """Texts of the sample never come to the driver; the model is that of the texts in order of their keys."""
    from tonegrid.llm import toxicity

    rows = [(k, ("you foulbrain Wretch, wretch" if k % 3 else "good day, Good day to you all") + f" word{k % 7} ünï{k % 5}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows], "doc_id long, toxic int")
    want = toxicity.fit([t for _, t in rows], [int(k % 3 > 0) for k, _ in rows])

    driver, real = os.getpid(), getattr(toxicity, "fit_bags", None)

    def elsewhere(*given):
        assert os.getpid() != driver, "trained on the driver"
        return real(*given)

    for name in ("fit", "fit_bags"):
        monkeypatch.setattr(toxicity, name, elsewhere, raising=False)
    got = toxicity.train(docs, labels)
    assert got.fitted and got.bias == want.bias and (got.weights == want.weights).all() and want.weights.any()


def test_components_take_few_stages(spark):
    """Stars end after a round; chains, copies of links, loops and hubs have the smallest node in reach."""
    from tonegrid.llm.simhash import components

    def run(pairs):
        spark.sparkContext.setJobGroup(name := f"components-{len(pairs)}", name)
        got = components(spark.createDataFrame(pairs, "a long, b long").coalesce(1))
        stages = {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup(name) for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
        return dict(got.collect()), len(stages)

    roots, stages = run([(1, k) for k in range(2, 9)])
    assert roots == dict.fromkeys(range(1, 9), 1)
    assert stages <= 30  # 43 with all of a round in one plan, and one round more
    rng = random.Random(5)
    chain = list(range(100, 140))
    rng.shuffle(chain)
    pairs = [*zip(chain, chain[1:], strict=False), (7, 7), (5, 6), (6, 5), (5, 6), *((50, k) for k in range(10, 30)), (29, 3), (-2, 50)]
    roots, _ = run(pairs)
    assert roots == dict.fromkeys(chain, 100) | {5: 5, 6: 5} | dict.fromkeys([*range(10, 30), 3, 50, -2], -2)
