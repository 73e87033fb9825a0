"""Type codes with their names and the classifier of each (fixed values)."""

from __future__ import annotations

#: code, name, human name, classifier
TYPES = [
    (0x01, "TEXT", "Text", "text"),
    (0x02, "BASE64", "Base 64", "text"),
    (0x03, "BASE85", "Base 85", "text"),
    (0x04, "HEX", "ASCII coded HEX", "text"),
    (0x10, "JPG", "JPG", "image"),
    (0x11, "PNG", "PNG", "image"),
    (0x12, "GIF", "Gif", "image"),
    (0x13, "FAX", "FAX", "image"),
    (0x14, "JBIG", "JBIG", "jbig"),
    (0x20, "ZIP", "Zip or OfficeX", "compression"),
    (0x21, "BZIP2", "BZip", "compression"),
    (0x22, "GZIP", "Gzip", "compression"),
    (0x23, "COMPRESS", "Compress", "compression"),
    (0x24, "ZLIB", "ZLIB", "zlib"),
    (0x30, "PDF", "PDF", "pdf"),
    (0x31, "OLE", "OLE", "ole"),
    (0x40, "MP3", "MP3", "video"),
    (0x41, "AAC", "AAC", "video"),
    (0x42, "MPEG", "Mpeg", "video"),
    (0x43, "H264", "H.264", "video"),
    (0x44, "AVI", "AVI", "video"),
    (0x45, "WMV", "WMV", "video"),
    (0x46, "FLV", "FLV", "video"),
    (0x50, "FAT12", "FAT12", "sleuth"),
    (0x51, "FAT16", "FAT16", "sleuth"),
    (0x52, "FAT32", "FAT32", "sleuth"),
    (0x53, "NTFS", "NTFS", "sleuth"),
    (0x54, "EXT", "EXT2/3/4", "sleuth"),
    (0x55, "PART", "Boot Record/Partition Table", "partitiontable"),
    (0x60, "UNIDENTIFIED", "Unidentified", None),
    (0x61, "CONSTANT", "Constant", None),
    (0xFF, "ALL", "Unknown", None),
]
BY_NAME = {name: code for code, name, _, _ in TYPES}
HUMAN = {code: human for code, _, human, _ in TYPES}

#: Order in which classifiers are asked; one that is missing here comes last.
PRECEDENCE = ["sleuth", "partitiontable", "ole", "pdf", "compression", "image", "video", "jbig", "text"]
LAST = 2147483646
THRESHOLD = 50


def registry(spark):
    """classifier, type_code, precedence, threshold: one row per type that a classifier claims."""
    rows = [(c, code, PRECEDENCE.index(c) if c in PRECEDENCE else LAST, THRESHOLD) for code, _, _, c in TYPES if c]
    return spark.createDataFrame(rows, "classifier string, type_code int, precedence int, threshold int")


def type_code(name: str) -> int:
    """Case-insensitive; -1 if there is no such name."""
    return BY_NAME.get(name.upper(), -1)


def type_human(code: int) -> str:
    return HUMAN.get(code, "Unknown")
