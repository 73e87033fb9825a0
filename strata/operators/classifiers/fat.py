"""FAT12/16/32 walked for allocated files; NTFS and EXT are recognised by their signatures only.

The volume is read by place, so its size does not matter. The verdict claims what is in use: the area before the
clusters, and the stretches of every directory and file (up to the file's size), not what is free or slack.
Files are told by where they lie.
"""

import struct

from strata.operators.classifiers import Verdict
from strata.sources.views import view


def is_ext(head: bytes) -> bool:
    """Two bytes of signature are borne by chance too, so the fields around them have to hold values that there are."""
    if len(head) < 0x450 or head[0x438:0x43A] != b"\x53\xef":
        return False
    (block,), (state, errors), (system, revision) = struct.unpack_from("<I", head, 0x418), struct.unpack_from("<HH", head, 0x43A), struct.unpack_from("<II", head, 0x448)
    return block <= 6 and state <= 7 and errors <= 3 and system <= 4 and revision <= 1


def classify(data):
    v = view(data)
    head = v.read(0, 2048)
    if head[3:7] == b"NTFS" or is_ext(head):
        name = "NTFS" if head[3:7] == b"NTFS" else "EXT"
        return Verdict("sleuth", 100, name, f"{name} file system")
    if head[54:58] != b"FAT1" and head[82:87] != b"FAT32":
        return Verdict("sleuth", 0, "FAT", "Not properly detected")
    sector, per, reserved, fats, roots, small, _, fat16 = struct.unpack_from("<HBHBHHBH", head, 11)
    big, fat32 = struct.unpack_from("<II", head, 32)
    total, fat_size = small or big, fat16 or fat32
    if not (sector and per and fats and fat_size and total):
        return Verdict("sleuth", 0, "FAT", "Not properly detected")
    root_at = (reserved + fats * fat_size) * sector
    data_at = root_at + -(-roots * 32 // sector) * sector
    clusters, size = (total - data_at // sector) // per, per * sector
    bits = 12 if clusters < 4085 else 16 if clusters < 65525 else 32
    table_at = reserved * sector

    def after(c: int) -> int:
        if bits == 12:
            b = v.read(table_at + c * 3 // 2, 2)
            x = struct.unpack("<H", b)[0] if len(b) == 2 else 0xFFF
            return x >> 4 if c & 1 else x & 0xFFF
        b = v.read(table_at + c * bits // 8, bits // 8)
        return int.from_bytes(b, "little") & 0x0FFFFFFF if len(b) == bits // 8 else last

    last = {12: 0xFF8, 16: 0xFFF8, 32: 0x0FFFFFF8}[bits]

    def stretches(c: int, most: int | None = None) -> list[tuple[int, int]]:
        """Where a chain of clusters lies, up to ``most`` bytes; a loop or a bad pointer ends it."""
        out, seen, left = [], set(), most
        while 2 <= c < min(last, clusters + 2) and c not in seen and left != 0:
            seen.add(c)
            at, n = data_at + (c - 2) * size, size if left is None else min(size, left)
            if out and sum(out[-1]) == at:
                out[-1] = (out[-1][0], out[-1][1] + n)
            else:
                out.append((at, n))
            left = None if left is None else left - n
            c = after(c)
        return out

    stored: list[tuple[str, list[tuple[int, int]]]] = []
    ranges = [(0, data_at)]
    first = stretches(struct.unpack_from("<I", head, 44)[0]) if bits == 32 else [(root_at, data_at - root_at)]
    todo, seen = [("", first)], set()
    while todo:
        path, places = todo.pop()
        ranges += [x for x in places if x[0] >= data_at]
        body = b"".join(v.read(*x) for x in places)
        for at in range(0, len(body) - 31, 32):
            name, ext, flags = body[at : at + 8], body[at + 8 : at + 11], body[at + 11]
            if name[:1] == b"\0":
                break
            if name[0] == 0xE5 or flags & 0x08 or name[:1] == b".":  # deleted, label or long name, self and parent
                continue
            high, low, length = struct.unpack_from("<H", body, at + 20)[0], *struct.unpack_from("<HI", body, at + 26)
            cluster = (high << 16 if bits == 32 else 0) | low
            full = path + name.decode("latin-1").rstrip() + ("." + ext.decode("latin-1").rstrip() if ext.strip() else "")
            if cluster in seen:
                continue
            seen.add(cluster)
            if flags & 0x10:
                todo.append((full + "/", stretches(cluster)))
            elif length:
                stored.append((full, stretches(cluster, length)))
                ranges += stored[-1][1]
    return Verdict("sleuth", 100, f"FAT{bits}", f"{total * sector} bytes ({clusters} units of {size} size)", total * sector, f"fat{bits}", ranges=ranges, stored=sorted(stored))
