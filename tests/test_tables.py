"""Table functions of SQL, and resource profiles of provider passes."""

import pytest

from tonegrid.operators.ordered import gaps
from tonegrid.providers import base, tables


@pytest.fixture(scope="module")
def clips(spark):
    loud, quiet = [0.5] * 50, [0.0] * 50
    rows = [("a", 100, loud + quiet + loud, 7), ("b", 100, quiet * 2, 8), ("c", 100, None, 9), ("d", 100, [], 10)]
    df = spark.createDataFrame(rows, "stimulus_id string, sr int, samples array<float>, extra long")
    df.createOrReplaceTempView("table_clips")
    tables.register_provider(spark, "stub_turns_of", base.StubTurns(sr=100))
    return df


def test_provider_over_a_table_keeps_its_columns(spark, clips):
    got = spark.sql("SELECT * FROM stub_turns_of(TABLE(table_clips))")
    assert got.columns == ["stimulus_id", "sr", "extra", "speaker", "onset", "offset"]
    assert sorted(map(tuple, got.collect())) == [("a", 100, 7, "S0", 0.0, 0.5), ("a", 100, 7, "S1", 1.0, 1.5)]
    plain = base.rows(clips.where("samples is not null"), base.StubTurns(sr=100)).collect()
    assert sorted((r.stimulus_id, r.onset, r.offset) for r in plain) == [("a", 0.0, 0.5), ("a", 1.0, 1.5)]


def test_provider_in_a_lateral_join(spark, clips):
    got = spark.sql("SELECT c.stimulus_id, r.speaker, r.onset FROM table_clips c, LATERAL stub_turns_of(c.sr, c.samples) r").collect()
    assert sorted(map(tuple, got)) == [("a", "S0", 0.0), ("a", "S1", 1.0)]


def test_faults_are_told_when_the_query_is_analysed(spark, clips):
    for text, told in (("SELECT * FROM stub_turns_of(TABLE(SELECT stimulus_id, sr FROM table_clips))", "no column samples"), ("SELECT * FROM stub_turns_of(TABLE(SELECT *, 1 AS onset FROM table_clips))", "already: onset")):
        with pytest.raises(Exception, match=told):
            spark.sql(text).schema


def test_gaps_over_partitions_equal_the_operator(spark):
    rows = [(f"s{i % 3}", float(i) if i % 11 else None, i + 0.25 if i % 7 else None) for i in range(500)] + [(None, 1.0, 2.0), (None, 5.0, 6.0)]
    words = spark.createDataFrame(rows, "stimulus_id string, onset double, offset double").repartition(5)
    words.createOrReplaceTempView("table_words")
    tables.register_gaps(spark, "word_gaps")
    text = "SELECT * FROM word_gaps(TABLE(SELECT stimulus_id, onset, `offset` FROM table_words) PARTITION BY stimulus_id ORDER BY (onset, `offset`))"
    cells = lambda rows: sorted((str(r[0]), str(r[1]), str(r[2])) for r in rows)
    want = cells(gaps(words).select("stimulus_id", "onset", "_gap").collect())
    assert cells(spark.sql(text).collect()) == want
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert cells(spark.sql(text).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert spark.sql(text.replace("FROM table_words", "FROM table_words WHERE onset > 900")).count() == 0


def test_a_profile_reaches_the_pass(spark, clips):
    profile = base.device_profile(0.5, cpus=2)
    assert profile.taskResources["gpu"].amount == 0.5 and profile.taskResources["cpus"].amount == 2

    def placed(df):
        found = df._jdf.queryExecution().logical().profile()
        return found.get().id() if found.isDefined() else None

    pcm = clips.withColumn("duration", clips["sr"] * 1.0)
    for with_, without in [(f(pcm, m, *a, profile=profile), f(pcm, m, *a)) for f, m, a in ((base.rows, base.StubTurns(sr=100), ()), (base.info, base.StubTurns(sr=100), ()), (base.embed, base.StubProvider(sr=100), (0.5,)))]:
        assert placed(with_) == profile.id and placed(without) is None
    own = base.device_profile(1, executor_devices=2, memory="8g", script="/opt/find.sh")
    assert own.executorResources["gpu"].amount == 2 and own.executorResources["memory"].amount == 8192
    with pytest.raises(base.ModelError):
        base.device_profile(1, memory="8g")
