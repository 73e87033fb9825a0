"""Integers, blocks, names and decoders over bytes and strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(data: Column, offset: int, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes at ``offset``."""
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")


def le_uint(data: Column, offset: int, size: int) -> Column:
    """Little-endian unsigned integer of ``size`` bytes at ``offset``."""
    total = None
    for i in range(size):
        part = F.conv(F.hex(F.substring(data, offset + 1 + i, 1)), 16, 10).cast("long") * (1 << 8 * i)
        total = part if total is None else total + part
    return total


def safe_name(name: Column) -> Column:
    """A member name with every character that is not printable ASCII as a dot, 2,047 at most."""
    return F.substring(F.regexp_replace(name, r"[^\x21-\x7E]", "."), 1, 2047)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def hex_decode(text: Column) -> Column:
    """Other characters are skipped and an odd last digit is dropped."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.substring(digits, F.lit(1), (F.length(digits) - F.length(digits) % 2).cast("int")))


def base64_decode(text: Column) -> Column:
    return F.unbase64(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""))


def path_depth(path: Column) -> Column:
    """Number of containers a path goes through."""
    return (F.size(F.split(path, ":mnt")) - 1).cast("int")


def path_streams(path: Column) -> Column:
    """Ids of the streams on the way, outermost first."""
    return F.transform(F.split(path, r":mnt-[^/]*/"), lambda p: F.element_at(F.split(p, "/"), -1))


def path_kinds(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r":mnt-([^/]*)/"), 1)
