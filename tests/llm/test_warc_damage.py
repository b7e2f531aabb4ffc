"""Records behind damaged, cut and short ones are still read."""

import gzip
import random

import pytest

from tonegrid.llm import warc

GOOD = [warc.record_bytes("response", f"g{k}", f"http://a.org/{k}", f"2024-01-0{k + 1}T00:00:00Z", 200, [("ETag", '"x"')], b"body %d" % k) for k in range(4)]
FINE = [(f"g{k}", True) for k in range(4)]


def big(size):
    rng = random.Random(size)
    return warc.record_bytes("response", "big", "http://b.org/", "2024-01-01T00:00:00Z", 200, [], rng.randbytes(size))


def names(raw):
    return [(r["record_id"], r["intact"]) for r in warc.parse_records(raw)]


@pytest.mark.parametrize("size", [3_500_000, 4_000_000, 200_000])
def test_damage_inside_a_member(size):
    member = bytearray(gzip.compress(big(size)))
    at = len(member) // 2
    member[at : at + 400] = b"\xff" * 400
    got = names(bytes(member) + b"".join(map(gzip.compress, GOOD)))
    assert got[-4:] == FINE and got[:-4] in ([("big", False)], [])


@pytest.mark.parametrize("keep", [0.5, 0.95, 0.01])
def test_cut_members(keep):
    member = gzip.compress(big(3_500_000))
    got = names(gzip.compress(GOOD[0]) + member[: int(len(member) * keep)] + b"".join(map(gzip.compress, GOOD)))
    assert got[0] == FINE[0] and got[-4:] == FINE and all(g == ("big", False) for g in got[1:-4])
    assert names(gzip.compress(GOOD[0]) + member[: int(len(member) * keep)])[:1] == FINE[:1]


def test_members_of_many_records():
    raw = gzip.compress(b"".join(GOOD)) + gzip.compress(GOOD[0])
    assert names(raw) == FINE + FINE[:1]


@pytest.mark.parametrize("digest", [True, False])
def test_short_plain_record(digest):
    """The block lacks 50 bytes, so its length reaches into the records behind it."""
    record = big(200)
    if not digest:
        record = b"".join(line for line in record.splitlines(keepends=True)[:8] if b"Digest" not in line) + b"".join(record.splitlines(keepends=True)[8:])
    short = record[:-54] + b"\r\n\r\n"
    for raw in (short + b"".join(GOOD), gzip.compress(short + b"".join(GOOD))):
        assert names(raw) == [("big", False), *FINE]


def test_a_sound_body_may_hold_records():
    inner = b"".join(GOOD)
    outer = warc.record_bytes("response", "outer", "http://c.org/", "2024-01-01T00:00:00Z", 200, [], inner)
    assert names(outer + GOOD[0]) == [("outer", True), FINE[0]]


def test_long_lengths_and_junk():
    wild = GOOD[0].replace(b"Content-Length: ", b"Content-Length: 99999")
    assert names(wild + GOOD[1] + b"\x00junk\r\n" + GOOD[2]) == [("g0", False), FINE[1], FINE[2]]
