"""Columns for bit fields, counts of bits and number spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_byte(word: Column, byte: Column, index: int) -> Column:
    """A 32-bit word whose byte ``index``, from the lowest, is replaced."""
    return word.bitwiseAND(F.lit(0xFFFFFFFF & ~(0xFF << 8 * index))).bitwiseOR(F.shiftleft(byte.bitwiseAND(255), 8 * index))


def lane_setting(lanes: Column) -> Column:
    return F.shiftleft(lanes - 1, 1)


def has_bit(flags: Column, bit: Column) -> Column:
    return F.call_function("getbit", flags.cast("long"), bit.cast("int")) == 1


def with_bit(flags: Column, bit: Column) -> Column:
    """The flags with one more bit set."""
    return flags.cast("long").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))


def parse_integer(text: Column) -> Column:
    """A decimal, 0x or leading-0 octal number; null for other texts."""
    low = F.lower(text)
    parsed = F.when(low.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(low, 3, 64), 16, 10)).when(low.rlike("^0[0-7]+$"), F.conv(low, 8, 10)).when(low.rlike("^[0-9]+$"), low)
    return parsed.cast("long")


def byte_list(text: Column) -> Column:
    """Bytes of a comma-separated list of hexadecimal numbers."""
    return F.transform(F.split(text, ","), lambda x: F.conv(F.trim(x), 16, 10).cast("int"))
