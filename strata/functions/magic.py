"""Signature detection as Column expressions over ``window BINARY``: no Python in the plan.

Order of the result: text family, file systems, CONSTANT or UNIDENTIFIED, tags, PART, PDF. A constant
block has no tags; a window under 32 bytes is UNIDENTIFIED.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.types import BY_NAME

#: Character classes of the first 32 bytes (fixed values).
TEXT_CLASSES = [
    ("TEXT", r"[\x20-\x7E\t\n\f\r]"),
    ("BASE64", r"[A-Za-z0-9+/=_\-.:! \r\n]"),
    ("BASE85", r"[A-Za-z0-9!#$%&()*+\-;<=>?@^_`{|}~ \r\n]"),
    ("HEX", r"[0-9A-Fa-f \r\n]"),
]
#: type, offset, bytes (fixed values)
FILE_SYSTEMS = [("FAT12", 54, "46415431"), ("FAT16", 54, "46415431"), ("FAT32", 82, "4641543332"), ("NTFS", 3, "4E544653"), ("EXT", 0x438, "53EF")]
#: type, leading hex digits (fixed values)
TAGS = [
    ("PNG", "89504E47"), ("GIF", "47494638"), ("ZIP", "504B0304"), ("OLE", "D0CF11E0"), ("AAC", "00000020"), ("AAC", "41444946"),
    ("MPEG", "00000001"), ("MPEG", "47400010"), ("AVI", "52494646"), ("WMV", "3026B275"), ("FLV", "464C5601"),
    ("MPEG", "000001B"), ("JPG", "FFD8FF"), ("BZIP2", "425A68"), ("GZIP", "1F8B"), ("COMPRESS", "1F9D"),
    ("ZLIB", "68DE"), ("ZLIB", "4889"), ("ZLIB", "78DA"), ("ZLIB", "789C"), ("MP3", "FFE"), ("MP3", "FFF"),
]
MIN_WINDOW = 32


def _bytes_at(window: Column, offset: int, digits: str) -> Column:
    return F.substring(window, offset + 1, len(digits) // 2) == F.unhex(F.lit(digits))


def is_constant(block: Column) -> Column:
    """The block repeats its first four bytes throughout."""
    h, n = F.hex(block), F.octet_length(block)
    return h == F.substring(F.repeat(F.substring(h, 1, 8), 1 + F.floor(n / 4).cast("int")), F.lit(1), (2 * n).cast("int"))


def text_flag(window: Column, name: str) -> Column:
    """The first 32 bytes are text, and of the class ``name``."""
    first = F.decode(F.substring(window, 1, MIN_WINDOW), "ISO-8859-1")
    classes = dict(TEXT_CLASSES)
    is_text = first.rlike(f"^{classes['TEXT']}{{32}}$")
    return is_text if name == "TEXT" else is_text & first.rlike(f"^{classes[name]}{{32}}$")


def detect(window: Column, block_size: int = 512) -> Column:
    """Type codes of a window (array<int>)."""
    n = F.octet_length(window)
    code = lambda name: F.lit(BY_NAME[name])
    text = [F.when(text_flag(window, name), code(name)) for name, _ in TEXT_CLASSES]
    systems = [F.when(_bytes_at(window, at, digits), code(name)) for name, at, digits in FILE_SYSTEMS]
    first = F.hex(F.substring(window, 1, 4))
    tags = [F.when(first.startswith(digits), code(name)) for name, digits in TAGS]
    part = F.when((n >= 512) & _bytes_at(window, 510, "55AA"), code("PART"))
    pdf = F.when(F.contains(F.substring(window, 1, 1024), F.unhex(F.lit("25504446"))), code("PDF"))  # by bytes; position() steps by characters
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    head = some(*text, *systems)
    constant = is_constant(F.substring(window, 1, block_size))
    return F.when(n < MIN_WINDOW, F.array(code("UNIDENTIFIED"))).otherwise(
        F.concat(head, F.when(constant, F.array(code("CONSTANT"))).otherwise(F.concat(F.array(code("UNIDENTIFIED")), some(*tags, part, pdf))))
    )
