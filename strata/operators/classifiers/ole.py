"""Compound documents: header, allocation tables, directory, and every stream in it."""

import struct

from strata.operators.classifiers import Verdict

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END = 0xFFFFFFFE
FREE = 0xFFFFFFFF


def chain(table: list[int], start: int) -> list[int]:
    """Follows next-pointers to the end of a chain; a loop or a bad pointer ends it."""
    out, seen = [], set()
    while start < len(table) and start not in seen:
        seen.add(start)
        out.append(start)
        start = table[start]
    return out


def classify(data: bytes):
    if data[:8] != MAGIC:
        return Verdict("ole", 0, "OLE", "not a compound document")
    if len(data) < 512:
        return Verdict("ole", 50, "OLE", "bad header")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    n_fat, dir_start, _, cutoff, mini_start, _, difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
    if not 7 <= shift <= 16 or mini_shift >= shift:
        return Verdict("ole", 50, "OLE", "bad header")
    size = 1 << shift
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    places = [x for x in struct.unpack_from("<109I", data, 76) if x < END]
    for _ in range(n_difat):
        block = sector(difat)
        if len(block) < size:
            break
        *more, difat = struct.unpack(f"<{size // 4}I", block)
        places += [x for x in more if x < END]
    fat: list[int] = []
    for i in places[:n_fat]:
        block = sector(i)
        fat += struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4])
    read = lambda start: b"".join(map(sector, chain(fat, start)))
    directory = read(dir_start)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        n, kind = struct.unpack_from("<HB", directory, at + 64)
        start, length = struct.unpack_from("<II", directory, at + 116)
        entries.append((directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), kind, *struct.unpack_from("<III", directory, at + 68), start, length))
    if not entries or entries[0][1] != 5:
        return Verdict("ole", 50, "OLE", "bad directory")
    mini_data = read(entries[0][5])
    block = read(mini_start)
    mini = list(struct.unpack(f"<{len(block) // 4}I", block))
    children: list[tuple[str, bytes]] = []
    todo, seen = [(entries[0][4], "")], set()
    while todo:
        i, path = todo.pop()
        if i >= len(entries) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        if kind == 2:
            if length >= cutoff:
                body = read(start)[:length]
            else:
                body = b"".join(mini_data[k << mini_shift : (k + 1) << mini_shift] for k in chain(mini, start))[:length]
            children.append((path + name, body))
        elif kind == 1:
            todo.append((child, f"{path}{name}/"))
        todo += [(left, path), (right, path)]
    used = max((i for i, x in enumerate(fat) if x != FREE), default=0)
    return Verdict("ole", 100, "OLE", f"compound document, {len(children)} stream(s)", min(len(data), (used + 2) << shift), "ole", sorted(children))
