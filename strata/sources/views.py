"""Bytes by place, whether they are held or lie in a file."""

from __future__ import annotations


class Reader:
    """Bytes of a file by place; what lies in the last megabyte that was read is not read again."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(max(n, 1 << 20))
        return self.data[at - self.at : at - self.at + n]


class Held:
    """A view of bytes."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n] if 0 <= at and n > 0 else b""


class Extents:
    """A view of stretches (pos, len) of a file, one behind the other."""

    def __init__(self, reader, parts: list[tuple[int, int]]):
        self.reader, self.parts, self.size = reader, parts, sum(n for _, n in parts)

    def places(self, at: int, n: int) -> list[tuple[int, int]]:
        """Where in the file the bytes at..at+n of the view lie."""
        out, begin = [], 0
        for pos, length in self.parts:
            low, high = max(at, begin), min(at + n, begin + length)
            if low < high:
                out.append((pos + low - begin, high - low))
            begin += length
        return out

    def read(self, at: int, n: int) -> bytes:
        return b"".join(self.reader.read(pos, m) for pos, m in self.places(at, n)) if 0 <= at else b""


def view(data):
    """A view as it is, bytes as a view."""
    return Held(data) if isinstance(data, (bytes, bytearray, memoryview)) else data
