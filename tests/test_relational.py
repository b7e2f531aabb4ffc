import random

from pyspark.sql import functions as F

from tonegrid.functions import scalars as S
from tonegrid.operators import context as C
from tonegrid.operators import grid as G
from tonegrid.operators import intervals as I
from tonegrid.operators import ordered as O
from tonegrid.operators import recall as R
from tonegrid.operators.beats_table import downbeats

SPAN = "stimulus_id string, segment_idx int, onset double, offset double"
TURN = "stimulus_id string, turn_idx int, speaker string, onset double, offset double"


def test_majority_speaker_sums_and_breaks_ties(spark):
    turns = spark.createDataFrame([("a", 0, "S2", 0.0, 2.0), ("a", 1, "S1", 2.0, 4.0), ("a", 2, "S2", 4.0, 5.0)], TURN)
    segments = spark.createDataFrame([("a", 0, 0.0, 5.0), ("a", 1, 1.0, 3.0), ("a", 2, 8.0, 9.0)], SPAN)
    got = {r.segment_idx: r.speaker for r in I.majority_speaker(segments, turns, 1.5).collect()}
    assert got == {0: "S2", 1: "S1", 2: ""}


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(5)
    span = lambda: (lambda a: (a, a + rng.random() * 9))(rng.random() * 60)
    left = [("ab"[k % 2], k, *span()) for k in range(60)]
    right = [("ab"[k % 2], k, *span()) for k in range(50)]
    pairs = I.interval_join(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), ("onset", "offset"), ("onset", "offset"), 3.0)
    got = sorted((r.segment_idx, r.r_segment_idx) for r in pairs.collect())
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString()


def test_word_owner_is_the_first_turn(spark):
    turns = spark.createDataFrame([("a", 0, "X", 0.0, 2.0), ("a", 1, "Y", 1.0, 3.0)], TURN)
    words = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 1.9, 2.1), ("a", 2, 5.0, 6.0)], "stimulus_id string, word_idx int, onset double, offset double")
    assert {r.word_idx: r.speaker for r in I.word_speakers(words, turns, width=1.0).collect()} == {0: "X", 1: "Y", 2: ""}


def test_voice_gender(spark):
    frames = spark.createDataFrame([("a", 0.25 + 0.5 * k, f) for k, f in enumerate([110.0, 112.0, None, 200.0, 210.0])], "stimulus_id string, time double, pitch_f0 double")
    segments = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 1.6, 2.4), ("a", 2, 9.0, 9.5)], SPAN)
    got = {r.segment_idx: (r.median_f0, r.voice_gender) for r in I.segment_voice(segments, frames, 0.5).collect()}
    assert got == {0: (111.0, "M"), 1: (205.0, "F"), 2: (None, "")}


def test_downbeats_are_strictly_near(spark):
    beats = spark.createDataFrame([("a", 1.0), ("a", 1.5), ("a", 2.0)], "stimulus_id string, time double")
    marks = spark.createDataFrame([("a", 1.029), ("a", 1.54)], "stimulus_id string, time double")
    assert {r.time: r.is_downbeat for r in downbeats(beats, marks).collect()} == {1.0: True, 1.5: False, 2.0: False}


def test_context_is_clamped(spark):
    native = spark.createDataFrame([("a", k + 0.5, float(k)) for k in range(10)], "stimulus_id string, t double, v double")
    d = spark.createDataFrame([("a", 10.0)], "stimulus_id string, duration double")
    got = {r.k: r for r in C.context_stats(native, G.spine(d, 1.0), d, 4.0, "v").collect()}
    assert got[0].context_mean == got[1].context_mean == 1.5 and got[9].context_mean == 7.5 and got[5].n_values == 4


def test_silence_and_gates(spark):
    r = spark.range(1).select(C.is_silent(F.lit(9.9e-5)).alias("a"), C.is_silent(F.lit(1e-4)).alias("b"), C.is_silent(F.lit(None).cast("double")).alias("c"), C.sharpness_gate(F.lit(1.0), F.lit(None).cast("double")).alias("d"), C.zero_is_missing(F.lit(0.0)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, True, None, None)


def test_recall(spark):
    pool = spark.createDataFrame([(0, "apple"), (1, "banana"), (2, "cherry")], "pool_index int, item string")
    words = spark.createDataFrame(
        [("a", 0, "Apple,", 1.0, 1.5, False), ("a", 1, "[UH]", 1.6, 1.7, True), ("a", 2, "bananna", 3.0, 3.4, False), ("a", 3, "zebra", 4.0, 4.4, False), ("a", 4, "apple", 6.0, 6.5, False)],
        "stimulus_id string, pos int, word string, onset double, offset double, is_filler boolean",
    )
    got = {r.pos: r for r in R.annotate_recall(words, pool).collect()}
    assert sorted(got) == [0, 2, 3, 4]
    assert got[2].matched_item == "banana" and got[2].match_score == 0.923 and got[2].irt == 2.0
    assert got[3].intrusion and got[3].pool_index == -1 and got[3].matched_item == "" and got[3].irt is None
    assert got[4].repetition and got[4].irt == 3.0 and got[0].irt is None
    s = R.recall_summary(R.annotate_recall(words, pool), 3).first()
    assert (s.n_recalled, s.n_intrusions, s.n_repetitions) == (2, 1, 1)


def test_timing_runs_and_filters(spark):
    words = spark.createDataFrame([("a", 0, "x", 0.0, 0.5), ("a", 1, "x", 1.0, 1.5), ("a", 2, "x", 1.6, 2.0), ("a", 3, "y", 2.0, 2.2)], "stimulus_id string, pos int, word string, onset double, offset double")
    t = O.speech_timing(words).first()
    assert (t.n_words, t.n_pauses, t.mean_pause_sec) == (4, 1, 0.5)
    assert O.longest_run(words, "word", ["pos"]).first().max_run == 3
    data = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(data)], "stimulus_id string, k int, v double")
    for size in (1, 2, 3, 4, 9):
        got = [r.smoothed for r in O.uniform_filter(df, "v", "k", size).orderBy("k").collect()]
        want = [sum(data[min(max(i + o, 0), 4)] for o in range(-(size // 2), size - size // 2)) / size for i in range(5)]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))


def test_scalars(spark):
    r = spark.range(1).select(S.normalise_word(F.lit("Don't-Ünï1")).alias("a"), S.clean_verbatim_word(F.lit(" ,-éa ")).alias("b"), S.is_filler(F.lit("[]")).alias("c"), S.amplitude_to_db(F.lit(0.0)).alias("d"), S.modulation_weight(F.lit(4.0)).alias("e"), S.voice_gender(F.lit(149.96)).alias("f")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("don'tn", "éa", False, -100.0, 1.0, "M")
