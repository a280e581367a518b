"""Slices, precincts and packets of codestreams as rows, by a table function that is called laterally.

What a codestream has is told by its layout, which follows from its picture header (geometry.packets); where a packet
begins follows from the lengths of those before it, so a codestream is walked by one task. Codestreams spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lumenframe.operators import codes, geometry

# Markers of slices without and with temporal coding and of the end; bytes of a slice header; bits of a packet header's three lengths.
SLICE, TEMPORAL, END, SLICE_BYTES = 0xFF20, 0xFF21, 0xFF11, 6
SHORT, LONG = (15, 13, 11), (20, 20, 15)
PACKET = "slice int, precinct int, packet int, at bigint, q int, raw boolean, sig bigint, cnt bigint, dat bigint, sgn bigint, filler bigint, error string"
LAYOUT = "array<struct<slice:int,precinct:int,packets:array<array<struct<band:int,flags:int>>>>>"


class Cut(ValueError):
    """A codestream that ends too early or doesn't hold what it should."""


def number(content: bytes, at: int, size: int) -> int:
    if at + size > len(content):
        raise Cut(f"cut short at byte {len(content)}")
    return int.from_bytes(content[at : at + size], "big")


def walked(content: bytes, bands: int, layout: list, short: bool, signs: bool) -> Iterator[tuple]:
    """Rows (PACKET) of a codestream from its first slice header on.

    A precinct's last packet has its filler. Where the codestream is cut short, or a slice, precinct or packet isn't what
    it should be, a row with the place and the error is the last one.
    """
    at, slice_, where, temporal = 0, -1, (None, None, None), False
    sizes = SHORT if short else LONG
    head = (1 + sum(sizes)) // 8
    try:
        for p in layout:
            where = (p["slice"], p["precinct"], None)
            if p["slice"] != slice_:
                slice_ = p["slice"]
                marker = number(content, at, 2)
                if marker not in (SLICE, TEMPORAL) or number(content, at + 2, 2) != 4 or number(content, at + 4, 2) != slice_:
                    raise Cut("no header of this slice")
                temporal, at = marker == TEMPORAL, at + SLICE_BYTES
            length, q, r = (number(content, at + i, n) for i, n in ((0, 3), (3, 1), (4, 1)))
            if not 0 < length < 1 << 20 or q > 31 or r >= 2 * bands:
                raise Cut("precinct header out of range")
            skip = 5 + 2 * temporal
            flags = (2 * bands * (1 + temporal) + 7) // 8
            modes, left = number(content, at + skip, flags), 8 * flags
            begin = at + skip + flags
            end = begin + length
            if end > len(content):
                raise Cut("the precinct runs past the end")
            pos, packets = begin, p["packets"]
            for k, entries in enumerate(packets):
                where = (slice_, p["precinct"], k)
                if pos + head > end:
                    raise Cut("the packets run past their precinct")
                bits, told = number(content, pos, head), []
                for size in reversed(sizes):
                    told.append(bits & ((1 << size) - 1))
                    bits >>= size
                sgn, cnt, dat = told
                raw, sgn = bool(bits & 1), sgn if signs else 0
                groups = 0 if raw else sum(e["flags"] for e in entries if modes >> (left - 2 - 2 * e["band"]) & 2)
                sig = (groups + 7) // 8
                first, pos = pos, pos + head + sig + cnt + dat + sgn
                if pos > end:
                    raise Cut("the packets run past their precinct")
                yield (*where, first, q, raw, sig, cnt, dat, sgn, end - pos if k == len(packets) - 1 else None, None)
            at = end
        where = (None, None, None)
        if number(content, at, 2) != END:
            raise Cut("no end marker")
    except Cut as e:
        yield (*where, at, *[None] * 6, None, str(e))


@udtf(returnType=PACKET)
class PacketWalk:
    """packet_walk(content, bands, layout, short, signs); null content has no rows."""

    def eval(self, content: bytes, bands: int, layout: list, short: bool, signs: bool) -> Iterator[tuple]:
        if content is not None:
            yield from walked(bytes(content), bands, layout or [], short, signs)


def layouts(pictures: DataFrame, columns: int, nlx: int, nly: int, components: int, apart: int, slice_rows: int) -> DataFrame:
    """(picture, layout): the entries of each packet of each precinct, with the significance flags of each entry's line.

    A slice has ``slice_rows`` rows of precincts. A layout is as long as its picture has packets; it is made of its
    picture's row alone.
    """
    every = geometry.filters(nlx, nly)

    def sized(number: Column) -> Column:
        _, row, wide = geometry.placed(number)
        sizes = [(geometry.high_size if high else geometry.low_size)(wide, F.lit(dx)) for dx, _, high, _ in [*every, (0, 0, False, False)]]
        flags = [F.ceil(size / float(geometry.GROUP * geometry.SIGNIFICANCE)).cast("int") for size in sizes]
        return F.struct(number.cast("int").alias("precinct"), row.alias("row"), F.array(*flags).alias("flags"))

    def precinct(x: Column) -> Column:
        entry = lambda f, band: F.struct(F.lit(band).alias("band"), x["flags"][f].alias("flags"))
        told = geometry.packet_entries(nlx, nly, components, apart, x["row"], entry)
        place = F.floor(x["row"] / slice_rows).cast("int").alias("slice")
        return F.struct(place, x["precinct"], F.transform(told, lambda p: p["entries"]).alias("packets"))

    each = geometry.tiled(pictures, columns, nlx, nly).withColumn("sized", F.transform("numbers", sized))  # a filter's flags are worked out once for all its entries
    return each.select("picture", F.transform("sized", precinct).cast(LAYOUT).alias("layout"))


def walk(spark: SparkSession, streams: DataFrame, key: str = "picture") -> DataFrame:
    """The key and PACKET rows of codestreams (key, content, bands, layout, short, signs)."""
    spark.udtf.register("packet_walk", PacketWalk)
    query = f"SELECT s.{key}, w.* FROM {{streams}} s, LATERAL packet_walk(s.content, s.bands, s.layout, s.short, s.signs) w"
    return spark.sql(query, streams=streams)


def packed_hex(modes: Column, lengths: Column, q: Column, filler: Column, short: bool = True) -> Column:
    """A precinct's bytes as hex digits, with zeros as what its packets hold.

    ``modes`` is an array of the bands' two-bit modes, ``lengths`` one of packets (raw, sig, cnt, dat, sgn).
    """
    sizes = SHORT if short else LONG
    digits = (1 + sum(sizes)) // 4

    def packet(x: Column) -> Column:
        head = F.lit(0).cast("long")
        for value, size in ((x["raw"].cast("long"), 1), *zip((x["dat"], x["cnt"], x["sgn"]), sizes)):
            head = F.shiftleft(head, size).bitwiseOR(value.cast("long"))
        return F.concat(F.lpad(F.hex(head), digits, "0"), F.repeat(F.lit("00"), (x["sig"] + x["cnt"] + x["dat"] + x["sgn"]).cast("int")))

    body = F.concat(F.array_join(F.transform(lengths, packet), ""), F.repeat(F.lit("00"), filler.cast("int")))
    bits = F.array_join(F.transform(modes, lambda m: F.lpad(F.bin(m), 2, "0")), "")
    once = lambda c, then: F.transform(F.array(c), then)[0]
    filled = once(bits, lambda b: F.rpad(b, (F.ceil(F.length(b) / 8) * 8).cast("int"), "0"))
    size = lambda b: F.lpad(F.hex((F.length(b) / 2).cast("long")), 6, "0")
    head = F.concat(F.lpad(F.hex(q.cast("long")), 2, "0"), F.lit("00"), once(filled, lambda b: F.hex(codes.bits_to_bytes(b))))
    return once(body, lambda b: F.concat(size(b), head, b))
