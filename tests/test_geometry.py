"""Packets and places of cells, worked out for each picture without sorting, gathering or broadcasting what is generated."""

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import geometry as g
from lumenframe.operators import packetwalk
from lumenframe.plans import coding
from lumenframe.plans import geometry as plans

PICTURES = [(1, 64, 9), (2, 300, 4), (3, 257, 13), (4, 1, 1)]
SETTINGS = [(1, 5, 2, 4, 1), (0, 3, 3, 3, 0), (2, 2, 1, 4, 2), (1, 2, 0, 3, 1)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def broadcasts_generated(df):
    """Whether a broadcast's subtree generates rows."""
    lines, depth = plan(df).splitlines(), lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                if "Generate " in below:
                    return True
    return False


@pytest.fixture
def pictures(spark):
    return spark.createDataFrame(PICTURES, "picture long, width long, height long")


def expected(bands, heights, setting):
    """The packets by sorting the lines of each precinct's bands."""
    _, nlx, nly, components, apart = setting
    flat, parts, found = nlx - nly + 1, components - apart, {}
    for b in bands:
        for line in range(b.first_line, b.end_line):
            order = (0, 0, 0, 0) if b.filter < flat else (1, (b.filter - flat) // 3, line - b.first_line, b.filter)
            found.setdefault((b.picture, b.precinct), {}).setdefault(order, []).extend((parts * b.filter + c, line) for c in range(parts))
        for line in range(min(1 << nly, heights[b.picture] - b.row * (1 << nly))):
            for c in range(apart):
                found[b.picture, b.precinct][2, line, c, 0] = [(parts * len(g.filters(nlx, nly)) + c, line)]
    return {
        (*key, packet, entry, band, line)
        for key, orders in found.items()
        for packet, order in enumerate(sorted(orders))
        for entry, (band, line) in enumerate(sorted(orders[order]))
    }


@pytest.mark.parametrize("setting", SETTINGS)
def test_packets_are_the_sorted_lines(spark, pictures, setting):
    columns, nlx, nly, components, apart = setting
    got = [tuple(r) for r in g.packets(pictures, columns, nlx, nly, components, apart).collect()]
    bands = g.band_precincts(pictures, columns, nlx, nly).collect()
    assert len(got) == len(set(got)) and set(got) == expected(bands, {p: h for p, _, h in PICTURES}, setting)


def test_packets_are_not_sorted(spark, sf_dir):
    text = plan(plans.packet_layout(spark, sf_dir))
    assert "Window" not in text and "Sort" not in text


@pytest.mark.parametrize("setting", SETTINGS)
def test_places_of_cells(spark, pictures, setting):
    columns, nlx, nly, *_ = setting
    rows = g.band_precincts(pictures, columns, nlx, nly).where("end_line > first_line AND band_width > 0").collect()
    cells = [(r.picture, r.precinct, r.filter, line, r.band_width - 1) for r in rows for line in range(r.first_line, r.end_line)]
    absent = [(1, 10_000, 0, 0, 0), (1, -1, 0, 0, 0), (1, 0, 99, 0, 0), (77, 0, 0, 0, 0)]
    table = spark.createDataFrame(cells + absent, "picture long, precinct long, filter int, line long, x long")
    got = {tuple(r)[:5]: tuple(r)[5:] for r in g.to_band_cells(table, pictures, columns, nlx, nly).collect()}
    want = {}
    for r in rows:
        # precincts to the left in this row are full: their widths of the band add up
        left = sum(o.band_width for o in rows if (o.picture, o.row, o.filter) == (r.picture, r.row, r.filter) and o.column < r.column)
        for line in range(r.first_line, r.end_line):
            want[r.picture, r.precinct, r.filter, line, r.band_width - 1] = (r.row * r.lines + line - r.first_line, left + r.band_width - 1)
    assert got == want


def test_no_generated_rows_are_broadcast(spark, sf_dir):
    assert not broadcasts_generated(plans.precinct_remap(spark, sf_dir))


def test_codestreams_are_made_of_their_row_alone(spark, sf_dir):
    text = plan(coding.codestreams(spark, sf_dir))
    assert "Join" not in text and "BroadcastExchange" not in text and "Aggregate" not in text


def test_walk_gathers_nothing(spark, sf_dir):
    text = plan(coding.packet_walk(spark, sf_dir))
    assert "Join" not in text and "BroadcastExchange" not in text and text.count("Exchange") == 1


@pytest.mark.parametrize("setting", SETTINGS)
def test_flags_are_worked_out_once_for_each_filter(spark, pictures, setting):
    columns, nlx, nly, components, apart = setting
    text = analyzed(packetwalk.layouts(pictures, columns, nlx, nly, components, apart, 2))
    assert text.count("32.0") == len(g.filters(nlx, nly)) + 1


def test_bits_of_modes_are_put_together_once(spark):
    told = F.array(F.struct(F.lit(False).alias("raw"), *[F.lit(1).alias(x) for x in ("sig", "cnt", "dat", "sgn")]))
    assert analyzed(spark.range(1).select(packetwalk.packed_hex(F.array("id"), told, F.lit(4), F.lit(0)).alias("t"))).count("bin(") == 1


@pytest.mark.parametrize("setting", SETTINGS)
def test_layouts_hold_the_packets(spark, pictures, setting):
    columns, nlx, nly, components, apart = setting
    flags = {(b.picture, b.precinct, b.filter): b.flags for b in g.band_precincts(pictures, columns, nlx, nly).collect()}
    wide = {(p.picture, p.precinct): (p.row, -(-p.precinct_width // 32)) for p in g.precincts(pictures, columns, nlx, nly).collect()}
    want, parts = {}, components - apart
    for r in sorted(g.packets(pictures, columns, nlx, nly, components, apart).collect()):
        row, whole = wide[r.picture, r.precinct]
        packets = want.setdefault(r.picture, {}).setdefault((row // 2, r.precinct), {})
        packets.setdefault(r.packet, []).append((r.band, flags.get((r.picture, r.precinct, r.band // parts), whole)))
    for r in packetwalk.layouts(pictures, columns, nlx, nly, components, apart, 2).collect():
        got = [(p.slice, p.precinct, [[tuple(e) for e in packet] for packet in p.packets]) for p in r.layout]
        assert got == [(*at, [packets[k] for k in sorted(packets)]) for at, packets in sorted(want[r.picture].items())]
