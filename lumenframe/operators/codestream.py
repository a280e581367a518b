"""Checks and profiles of codestream headers and packet tables, and the sizes of wavelet bands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("sig", "cnt", "dat", "sgn")
# Markers that begin a codestream, its two first segments, those it must have once, those allowed, and those that end its headers.
SOC, CAP, PIH, CDT, WGT = 0xFF10, 0xFF50, 0xFF12, 0xFF13, 0xFF14
ALLOWED, AFTER = frozenset([CAP, PIH, CDT, WGT, 0xFF15, 0xFF16, 0xFF17, 0xFF18, 0xFF19, 0xFF1A, 0xFF1B]), frozenset([0xFF20, 0xFF21, 0xFF11])
COMMENT = 0xFF15
# Fields of a picture header and their bits.
PICTURE = [("lcod", 32), ("profile", 16), ("level", 16), ("width", 16), ("height", 16), ("cw", 16), ("slice_lines", 16), ("components", 8), ("ng", 8), ("ss", 8), ("bw", 8), ("fq", 4), ("br", 4), ("fslc", 1), ("ppoc", 3), ("transform", 4), ("nlx", 4), ("nly", 4), ("lh", 1), ("rl", 1), ("qpih", 2), ("fs", 2), ("rm", 2)]


def header_errors(h: DataFrame) -> DataFrame:
    """Adds ``errors``: the rules that a picture header breaks, in a fixed order."""
    c = F.col
    rules = [
        (c("width") > 0, "width"),
        (c("height") > 0, "height"),
        (c("components").between(1, 8), "components"),
        (c("nly") <= c("nlx"), "vertical levels"),
        (c("nlx").between(1, 5), "horizontal levels"),
        ((c("transform") != 1) | (c("components") >= 3), "colour transform"),
        ((c("transform") != 3) | (c("components") == 4), "mosaic transform"),
        (c("bits").between(8, 16), "bit depth"),
    ]
    return h.withColumn("errors", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for ok, name in rules])))


def inferred_significance(packets: DataFrame) -> Column:
    """Bytes of the significance flags that a packet's groups need; none in raw mode."""
    return F.when(F.col("raw"), 0).otherwise(F.ceil(F.col("groups") / 8))


def profile(packets: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of each kind, their share of all, raw packets and bits for each sample."""
    out = packets.groupBy(*by).agg(*[F.sum(f"{k}_bytes").alias(k) for k in KINDS], F.count_if("raw").alias("raw_packets"), F.sum("samples").alias("samples"), F.sum(inferred_significance(packets)).alias("sig_needed"))
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    shares = [(F.col(k) * 100 / total).alias(f"{k}_percent") for k in KINDS]
    return out.select(*by, *KINDS, *shares, "raw_packets", "sig_needed", (total * 8 / F.col("samples")).alias("bits_per_sample"))


def precinct_sizes(packets: DataFrame, by: list[str], raw_bits: int = 4) -> DataFrame:
    """Bytes of each precinct, whose packets are coded or raw, whichever is shorter, and how many are raw.

    A raw packet has ``raw_bits`` bits for each group's count and no significance flags.
    """
    kept = F.col("dat_bytes") + F.col("sgn_bytes")
    raw, told = F.ceil(F.col("groups") * raw_bits / 8), F.col("sig_bytes") + F.col("cnt_bytes")
    return packets.groupBy(*by).agg(F.sum(kept + F.least(raw, told)).alias("bytes"), F.count_if(raw < told).alias("raw_packets"))


def overlong(packets: DataFrame) -> DataFrame:
    """Packets whose declared bytes are fewer than those used or run past their precinct."""
    used = sum((F.col(f"{k}_bytes") for k in KINDS[1:]), F.col(f"{KINDS[0]}_bytes"))
    return packets.where((F.col("declared") < used) | (F.col("declared") > F.col("precinct_bytes")))


def band_sizes(pictures: DataFrame, nlx: int, nly: int) -> DataFrame:
    """(picture, band, width, height) of pictures (picture, width, height), in order of their bands.

    The first nlx - nly levels split columns only. A low band has half of the columns or lines, up; a high one the rest.
    """
    low = lambda n, k: F.ceil(n / float(1 << k))
    high = lambda n, k: F.floor(low(n, k - 1) / 2)
    w, h = F.col("width"), F.col("height")
    bands = [("LL", low(w, nlx), low(h, nly))]
    bands += [(f"HL{k}", high(w, k), low(h, nly)) for k in range(nlx, nly, -1)]
    for k in range(nly, 0, -1):
        bands += [(f"HL{k}", high(w, k), low(h, k)), (f"LH{k}", low(w, k), high(h, k)), (f"HH{k}", high(w, k), high(h, k))]
    rows = [F.struct(F.lit(i).alias("band"), F.lit(n).alias("name"), a.cast("long").alias("width"), b.cast("long").alias("height")) for i, (n, a, b) in enumerate(bands)]
    return pictures.select("picture", F.explode(F.array(*rows)).alias("b")).select("picture", "b.*")


def header_segments(content: bytes) -> tuple[list[tuple[int, int, int]], str]:
    """(marker, place, length) of each header segment after the start, and what is wrong, empty if nothing is."""
    two = lambda at: int.from_bytes(content[at : at + 2], "big") if at + 2 <= len(content) else -1
    found, at = [], 2
    if two(0) != SOC:
        return [], "no start"
    while (marker := two(at)) not in AFTER:
        length = two(at + 2)
        if marker < 0xFF01 or marker == 0xFFFF:
            return found, "no marker"
        if length < 2 or at + 2 + length > len(content):
            return found, "length"
        if marker not in ALLOWED:
            return found, "unexpected marker"
        found.append((marker, at, length))
        at += 2 + length
    kinds = [m for m, _, _ in found]
    if kinds[:2] != [CAP, PIH]:
        return found, "order"
    if any(kinds.count(m) > 1 for m in ALLOWED - {COMMENT}):
        return found, "repeated segment"
    return found, "" if CDT in kinds and WGT in kinds else "missing segment"


def scan_headers(files: DataFrame) -> DataFrame:
    """(picture, segments, header, error) of codestreams (picture, content): what a scan up to the first slice finds.

    ``header`` has the fields of PICTURE, null where there is no picture header of 24 bytes.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments, headers, errors = [], [], []
            for content in b.column("content").to_pylist():
                found, error = header_segments(content or b"")
                own = next((content[at + 4 : at + 2 + n] for m, at, n in found if m == PIH and n == 26), None)
                fields, left = {}, sum(bits for _, bits in PICTURE)
                for name, bits in PICTURE if own else ():
                    left -= bits
                    fields[name] = int.from_bytes(own, "big") >> left & ((1 << bits) - 1)
                segments.append([{"marker": m, "at": at, "length": n} for m, at, n in found])
                headers.append(fields or None)
                errors.append(error)
            kinds = pa.list_(pa.struct([(c, pa.int32()) for c in ("marker", "at", "length")])), pa.struct([(n, pa.int64()) for n, _ in PICTURE]), pa.string()
            yield pa.RecordBatch.from_arrays([b.column("picture"), *[pa.array(x, k) for x, k in zip((segments, headers, errors), kinds)]], ["picture", "segments", "header", "error"])

    fields = ", ".join(f"{n}: long" for n, _ in PICTURE)
    return files.select("picture", "content").mapInArrow(read, f"picture long, segments array<struct<marker: int, at: int, length: int>>, header struct<{fields}>, error string")


def coding_errors(h: DataFrame) -> DataFrame:
    """Adds ``errors``: the rules that a picture header breaks in its settings, in a fixed order.

    Beside the fields of PICTURE, h has bits (of the first component), sx_most, sy_most, alike (whether all components have
    the same bits), plain (whether the first components aren't subsampled), nlt (0 for none), cts, crg, apart, and cap, the
    capabilities as bits from 1: star, quadratic, extended, vertical, apart, lossless, and 8, raw mode for each packet.
    """
    c, has = F.col, lambda bit: F.col("cap").bitwiseAND(1 << bit) > 0
    lossless, unit = c("fq") == 0, F.lit(1).cast("long") * F.col("sx_most") * F.pow(F.lit(2.0), F.col("nlx")).cast("long")
    cell = 8 * c("cw") * unit
    rules = [
        (c("components").between(1, 8), "components"),
        ((c("ng") == 4) & (c("ss") == 8), "groups"),
        (c("nlx").between(1, 8), "horizontal levels"),
        ((c("nly") >= F.log2(c("sy_most"))) & (c("nly") <= F.least(c("nlx"), F.lit(6))), "vertical levels"),
        ((c("fslc") == 0) & (c("ppoc") == 0), "order"),
        (c("transform").isin(0, 1, 3), "transform"),
        ((c("qpih") <= 1) & (c("fs") <= 1) & (c("rm") <= 1), "modes"),
        (c("slice_lines") >= 1, "slice height"),
        (c("bits").between(8, 16), "bit depth"),
        (c("width") >= unit, "width"),
        (c("height") >= c("sy_most") * F.pow(F.lit(2.0), c("nly")), "height"),
        ((c("cw") == 0) | (c("width") % F.greatest(cell, F.lit(1)) >= unit), "precinct width"),
        (~lossless | ((c("bw") == c("bits")) & c("alike") & (c("br") == F.when(c("bits") <= 12, 4).otherwise(5)) & (c("nlt") == 0) & has(6)), "lossless"),
        (lossless | c("bw").isin(18, 20), "coefficient bits"),
        (lossless | (c("bw") != 18) | ((c("fq") == 6) & (c("br") == 4) & (c("nlt") > 0) & (has(2) | has(3))), "18 bits"),
        (lossless | (c("bw") != 20) | ((c("fq") == 8) & (c("br") == 4) & ~has(2) & ~has(3)), "20 bits"),
        ((c("nlt") == 0) | ((c("nlt") == 1) & has(2)) | ((c("nlt") == 2) & has(3)), "curve"),
        ((c("transform") != 1) | ((c("components") >= 3) & c("plain")), "colour transform"),
        ((c("transform") != 3) | ((c("components") >= 4) & c("plain") & c("cts") & c("crg") & has(1)), "mosaic transform"),
        ((c("transform") == 3) | ~c("cts"), "stray settings"),
        ((c("apart") == 0) | ((c("components") > 3) & (c("apart") < c("components")) & has(5)), "components apart"),
        (has(4) == (c("sy_most") > 1), "vertical capability"),
        (has(8) == (c("rl") == 1), "raw capability"),
    ]
    return h.withColumn("errors", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for ok, name in rules])))


def encoder_stats(coded: DataFrame, by: list[str]) -> DataFrame:
    """Least, most and mean quantisation, and the filler that precincts need up to their budget."""
    filler = F.sum(F.greatest(F.col("budget") - F.col("bytes"), F.lit(0)))
    return coded.groupBy(*by).agg(F.min("q").alias("min_q"), F.max("q").alias("max_q"), F.avg("q").alias("mean_q"), filler.alias("filler_bytes"))


def histograms(coded: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, value, n): how often each value of some columns occurs, from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("long").alias("value")) for c in columns])).alias("e")
    return coded.select(each).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))
