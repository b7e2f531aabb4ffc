import pytest

from tonegrid.errors import ModelError
from tonegrid.operators import transcripts as T


def decoded(spark, rows):
    return spark.createDataFrame(rows, T.DECODED)


def word(text, at=0.0):
    return (text, at, at + 0.2, 0.9)


def test_flatten_verbatim(spark):
    rows = [("a", [(" hello", 0.0, 1.0, 0.0, 0.1, [word(", hello"), word(" - ")]), ("x", 1.0, 2.0, 0.0, 0.1, [word("...")]), ("y", 2.0, 3.0, -1.0, 0.1, [word("[UH]", 2.0), word("éa", 2.5)])]), ("b", [])]
    segments, words = T.flatten(decoded(spark, rows), verbatim=True)
    assert [(r.stimulus_id, r.segment_idx, r.text) for r in segments.orderBy("segment_idx").collect()] == [("a", 0, "hello"), ("a", 1, "[UH] éa")]
    assert [(r.pos, r.word, r.is_filler) for r in words.orderBy("pos").collect()] == [(0, "hello", False), (1, "[UH]", True), (2, "éa", False)]
    assert segments.orderBy("segment_idx").collect()[1].asr_confidence == pytest.approx(0.3679, abs=1e-4)


def test_degenerate_loops_are_decoded_again(spark):
    loop, fine = ("a", [("x", 0.0, 1.0, 0.0, 0.0, [word("no")] * 7)]), ("b", [("x", 0.0, 1.0, 0.0, 0.0, [word("yes")] * 6)])
    again = lambda bad, penalty: bad.join(decoded(spark, [("a", [("ok", 0.0, 1.0, 0.0, 0.0, [word("ok")])])]), "stimulus_id")
    got = {r.stimulus_id: (r.retried, len(r.segments[0].words)) for r in T.retry(decoded(spark, [loop, fine]), again).collect()}
    assert got == {"a": (True, 1), "b": (False, 6)}


def test_rules():
    with pytest.raises(ModelError):
        T.check_verbatim(True, "own", None)
    with pytest.raises(ModelError):
        T.check_verbatim(True, None, "fr")
    with pytest.raises(ValueError):
        T.check_rate(22_050)
