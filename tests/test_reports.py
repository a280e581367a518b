"""Modes of counts, files of a run, rig settings and intermediate tables, by plain versions and hand-made cases."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.operators import codes
from lumenframe.sources import captures, reports

FRAMES = "camera string, arrival long, frame_number long, dropped long, bytes_written long, frame_size long, timestamp_s long, timestamp_ns long, received_s long, received_ns long"


@pytest.mark.parametrize("each_packet", [True, False])
@pytest.mark.parametrize("raw_bits", [1, 3, 4])
def test_modes_by_hand(spark, each_packet, raw_bits):
    """Two slices of two precincts of four lines; bands 0 and 1 are in the upper lines, 2 and 3 in the lower."""
    r = random.Random(raw_bits)
    planes = {(y, g): r.choice([0, 1, 2, 2, 7, 9]) for y in range(16) for g in range(6)}
    cuts = {y: y // 4 + 1 for y in range(16)}
    rows = [(0, y, g, n, cuts[y]) for (y, g), n in planes.items()]
    told = codes.count_bits(spark.createDataFrame(rows, "plane int, y long, g long, planes long, cut long"), ["plane", "g"], "y", "cut", 8)
    half = F.expr("y % 4 div 2")
    cells = told.select(F.expr("y div 4").alias("precinct"), (F.col("y") % 4).alias("packet"), half.alias("set"), (half * 2 + F.expr("g div 3")).alias("band"), "flat", "up")
    got = {(x.precinct, x.packet): (x.raw, x.coded_bytes, x.raw_bytes, x.bytes, x.predicted) for x in codes.count_modes(cells, ["precinct"], F.col("precinct") % 2 == 0, raw_bits, each_packet).collect()}

    def bits(y, g, up):
        held, base = max(planes[y, g], cuts[y]), cuts[y]
        if up and y % 8:
            base = max(planes[y - 1, g], cuts[y], cuts[y - 1])
        d, theta = held - base, base - cuts[y]
        return 1 + (d + theta if d > theta else -2 * d - 1 if d < 0 else 2 * d)

    for p in range(4):
        for s in (0, 1):
            lines, above = [4 * p + 2 * s, 4 * p + 2 * s + 1], {}
            for b in (0, 1):
                flat, up = (sum(bits(y, g, u) for y in lines for g in range(3 * b, 3 * b + 3)) for u in (False, True))
                above[b] = up < flat and p % 2 == 1
            coded = [-(-sum(bits(y, g, above[g // 3]) for g in range(6)) // 8) for y in lines]
            raw = -(-6 * raw_bits // 8)
            for y, size in zip(lines, coded):
                is_raw = size > raw if each_packet else sum(coded) > 2 * raw
                assert got[p, y % 4] == (is_raw, size, raw, raw if is_raw else size, 0 if is_raw else sum(above.values()))


def test_the_log_of_each_camera(spark, tmp_path):
    rows = [(f"c{i % 2}", i, i if i % 3 else None, -1, 10, 10, 100 + i // 4, i * 1000, 100 + i // 4, i * 1000 + 2_500_000) for i in range(40)]
    frames, folder = spark.createDataFrame(rows, FRAMES).repartition(4), f"file://{tmp_path}/log"
    for part in (frames, frames.where("arrival < 30")):  # the second run takes the place of the first
        reports.write_log(part, folder)
    assert sorted(f for f in os.listdir(f"{tmp_path}/log") if f.startswith("camera=")) == ["camera=c0", "camera=c1"]
    for c in (0, 1):
        lines, files = [], sorted(f for f in os.listdir(f"{tmp_path}/log/camera=c{c}") if f.endswith(".csv"))
        for f in files:
            head, *rest = open(f"{tmp_path}/log/camera=c{c}/{f}").read().splitlines()
            assert head == ",".join(reports.LOG)
            lines += [x.split(",") for x in rest]
        mine = [r for r in rows if r[0] == f"c{c}" and r[1] < 30]
        assert [int(x[1]) for x in lines] == [-1 if r[2] is None else r[2] for r in mine]
        assert [x[0] for x in lines] == [f"{(r[6] - mine[0][6]) + (r[7] - mine[0][7]) / 1e9:.6f}" for r in mine]
        assert all(x[6] == "0x00000000" and x[3] == "-1" and x[-1] == "2.500" for x in lines)
    assert reports.read_log(spark, folder).count() == 30


def test_the_summary_is_one_object(spark, tmp_path):
    told = spark.createDataFrame([("b", 1.5, True, ""), ("a", 0.25, False, 'a "quoted" reason')], "camera string, gbps double, pass boolean, reason string")
    for _ in range(2):
        reports.write_summary(told, f"file://{tmp_path}/sum", receiver="roce")
    files = [f for f in os.listdir(f"{tmp_path}/sum") if f.endswith(".json")]
    assert len(files) == 1 and open(f"{tmp_path}/sum/{files[0]}").read().count("\n") == 1
    got = reports.read_summary(spark, f"file://{tmp_path}/sum", told).collect()
    assert [tuple(r) for r in got] == [("roce", 1.75, False, "a", 0.25, False, 'a "quoted" reason'), ("roce", 1.75, False, "b", 1.5, True, "")]


def test_settings_that_are_not_told(spark):
    rigs = [(1, '{"cameras": [{"port": "J1"}]}'), (2, '{"board_ip": "1.2.3.4", "p22": {"enabled": false}, "ibv_port": 2, "cameras": [{"port": "J2", "test_pattern_select": 3}]}')]
    one, two = sorted(captures.rig_cameras(spark.createDataFrame(rigs, "config int, json string")).collect())
    assert (one.board_ip, one.ibv_name, one.ibv_port, one.cuda_device, one.leading_lines, one.board_required, one.reset_board) == ("192.168.0.2", "", 1, 0, 0, True, True)
    assert (one.p22_enabled, one.p22_expander_address, one.test_pattern_select) == (True, 32, 0)
    assert (two.board_ip, two.ibv_port, two.p22_enabled, two.p22_expander_address, two.test_pattern_select) == ("1.2.3.4", 2, False, 32, 3)


def test_threads_keep_their_tables(spark):
    kept, step = {}, threading.Barrier(2)

    def work(n):
        since = storage.mark()
        kept[n] = storage.stored(spark.range(n), "own")
        step.wait(60)
        if n == 3:
            storage.discard(spark, since)
        step.wait(60)
        kept[n, "left"] = storage.mark() - since

    threads = [threading.Thread(target=work, args=(n,)) for n in (3, 5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join(120)
    assert kept[5].count() == 5 and (kept[3, "left"], kept[5, "left"]) == (0, 1)
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(kept[3].inputFiles()[0]).count()
