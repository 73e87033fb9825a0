"""Boot records: four entries, and the chain of extended ones wherever they lie."""

import struct

from strata.operators.classifiers import Verdict
from strata.sources.views import view

#: partition types with names (fixed values; others are "Unknown")
NAMES = {0x01: "FAT12", 0x04: "FAT16 <32M", 0x05: "Extended", 0x06: "FAT16", 0x07: "HPFS/NTFS", 0x0B: "W95 FAT32", 0x0C: "W95 FAT32 (LBA)", 0x0E: "W95 FAT16 (LBA)", 0x0F: "W95 Ext'd (LBA)", 0x82: "Linux swap", 0x83: "Linux", 0x85: "Linux extended", 0x8E: "Linux LVM", 0xA5: "FreeBSD", 0xAF: "HFS / HFS+", 0xEE: "GPT", 0xEF: "EFI (FAT-12/16/32)", 0xFD: "Linux raid autodetect"}
EXTENDED = (0x05, 0x0F, 0x85)
SECTOR = 512


def entries(sector: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """boot flag, type, packed first and last CHS, first sector, sectors."""
    out = []
    for i in range(4):
        boot, h0, s0, c0, kind, h1, s1, c1, first, n = struct.unpack_from("<8B2I", sector, 446 + 16 * i)
        chs = lambda c, h, s: (c | (s & 0xC0) << 2) << 14 | h << 6 | s & 0x3F
        out.append((boot, kind, chs(c0, h0, s0), chs(c1, h1, s1), first, n))
    return out


def empty(e) -> bool:
    return not any(e)


def valid(e) -> bool:
    return empty(e) or (e[0] in (0, 0x80) and e[3] >= e[2])


def classify(data):
    """The verdict claims the boot record's sector and that of every extended record that is there, no partition's data."""
    v = view(data)
    first = v.read(0, SECTOR)
    if len(first) < SECTOR or first[510:512] != b"\x55\xaa":
        return Verdict("partitiontable", 0, "PART", "no partition table")
    table = entries(first)
    if all(map(empty, table)) or not all(map(valid, table)):
        return Verdict("partitiontable", 50, "PART", "invalid partition table", weak=True)
    found, ok, ranges = [e for e in table if not empty(e)], True, [(0, SECTOR)]
    for base in [e[4] for e in table if e[1] in EXTENDED]:
        at, seen = base, set()
        while at not in seen and (sector := v.read(at * SECTOR, SECTOR)):
            seen.add(at)
            if len(sector) < SECTOR or sector[510:] != b"\x55\xaa":
                ok = False
                break
            ranges.append((at * SECTOR, SECTOR))
            own, link, *_ = entries(sector)
            found += [] if empty(own) else [own]
            if link[1] not in EXTENDED:
                break
            at = base + link[4]
    text = ", ".join(f"{NAMES.get(e[1], 'Unknown')} ({e[5]} sectors)" for e in found)
    return Verdict("partitiontable", 100 if ok else 50, "PART", text, SECTOR, ranges=ranges)
