"""Codestreams made byte by byte, walked to their packets."""

import pytest

from lumenframe.operators import packetwalk as w

LAYOUT = [
    {"slice": 0, "precinct": 0, "packets": [[{"band": 0, "flags": 9}, {"band": 1, "flags": 8}], [{"band": 1, "flags": 1}]]},
    {"slice": 0, "precinct": 1, "packets": [[{"band": 0, "flags": 2}]]},
    {"slice": 1, "precinct": 2, "packets": [[{"band": 1, "flags": 3}]]},
]


def packet(raw, sig, cnt, dat, sgn, short=True, signs=True):
    a, b, c = w.SHORT if short else w.LONG
    head = ((((raw << a | dat) << b) | cnt) << c) | sgn
    return head.to_bytes((1 + a + b + c) // 8, "big") + bytes(sig + cnt + dat + (sgn if signs else 0))


def precinct(modes, body, q=4, temporal=False):
    """modes: two bits a band, here for two bands."""
    return len(body).to_bytes(3, "big") + bytes([q, 1]) + (bytes([7, 7]) if temporal else b"") + bytes([modes << (0 if temporal else 4) if temporal else modes << 4]) + body


def stream(short=True, signs=True, temporal=False):
    """Bands with flags: the second of the first precinct (mode 01 10), both of the second and third."""
    mark = bytes([0xFF, 0x21 if temporal else 0x20, 0, 4, 0])
    modes = (lambda m: m << 4) if temporal else (lambda m: m)
    one = precinct(modes(0b0110), packet(0, 1, 2, 3, 1, short, signs) + packet(1, 0, 5, 0, 0, short, signs) + bytes(4), 9, temporal)
    two = precinct(modes(0b1010), packet(0, 1, 0, 0, 2, short, signs), 4, temporal)
    three = precinct(modes(0b1011), packet(0, 1, 1, 1, 1, short, signs), 31, temporal)
    return mark + b"\0" + one + two + mark + b"\1" + three + b"\xff\x11"


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("signs", [True, False])
@pytest.mark.parametrize("temporal", [True, False])
def test_packets_of_a_codestream(short, signs, temporal):
    rows = list(w.walked(stream(short, signs, temporal), 2, LAYOUT, short, signs))
    sgn = lambda n: n if signs else 0
    want = [(0, 0, 0, 9, False, 1, 2, 3, sgn(1), None), (0, 0, 1, 9, True, 0, 5, 0, 0, 4), (0, 1, 0, 4, False, 1, 0, 0, sgn(2), 0), (1, 2, 0, 31, False, 1, 1, 1, sgn(1), 0)]
    assert [(*r[:3], *r[4:11]) for r in rows] == want and all(r[11] is None for r in rows)
    assert [r[3] for r in rows] == sorted(r[3] for r in rows)


def test_cut_anywhere_is_an_error_row():
    whole = stream()
    full = list(w.walked(whole, 2, LAYOUT, True, True))
    for n in range(len(whole)):
        rows = list(w.walked(whole[:n], 2, LAYOUT, True, True))
        assert rows[:-1] == full[: len(rows) - 1] and rows[-1][11] and rows[-1][5] is None


@pytest.mark.parametrize(("at", "value", "error"), [(1, 0x22, "header of this slice"), (5, 3, "header of this slice"), (9, 32, "out of range"), (10, 4, "out of range"), (8, 10, "run past their precinct"), (8, 0, "out of range"), (8, 200, "runs past the end")])
def test_what_is_not_what_it_should_be(at, value, error):
    broken = bytearray(stream())
    broken[at] = value
    rows = list(w.walked(bytes(broken), 2, LAYOUT, True, True))
    assert error in rows[-1][11]


def test_no_end_marker_and_no_layout():
    rows = list(w.walked(stream()[:-1] + b"\x12", 2, LAYOUT, True, True))
    assert len(rows) == 5 and "end marker" in rows[-1][11] and rows[-1][:3] == (None, None, None)
    assert list(w.walked(b"\xff\x11", 2, [], True, True)) == []


def test_lateral_call(spark):
    rows = [(1, stream(), 2, LAYOUT, True, True), (2, stream()[:40], 2, LAYOUT, True, True), (3, None, 2, LAYOUT, True, True)]
    frame = spark.createDataFrame(rows, f"picture bigint, content binary, bands int, layout {w.LAYOUT}, short boolean, signs boolean")
    got = w.walk(spark, frame).collect()
    assert [r.picture for r in got].count(1) == 4 and {r.error is None for r in got if r.picture == 2} == {True, False} and not any(r.picture == 3 for r in got)
