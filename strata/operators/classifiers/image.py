"""PNG, GIF and JPEG: size, depth and exact length from their headers, chunks and segments."""

import struct

from strata.operators.classifiers import Verdict


def png(data: bytes):
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return None
    w, h, depth = struct.unpack_from(">IIB", data, 16)
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        at += 12 + n
        if kind == b"IEND":
            break
    return Verdict("image", 100, "PNG", f"{w}x{h}, {depth} bit", min(at, len(data)))


def gif(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at, frames = 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0), 0

    def blocks(at):
        while at < len(data) and data[at]:
            at += 1 + data[at]
        return at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            at = blocks(at + 2)
        elif data[at] == 0x2C:
            frames += 1
            local = data[at + 9]
            at = blocks(at + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
        else:
            break
    return Verdict("image", 100, "GIF", f"{w}x{h}, {frames} frame(s)", min(at + 1, len(data)))


def jpg(data: bytes):
    if data[:3] != b"\xff\xd8\xff":
        return None
    at, size, exif = 2, None, False
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            exif = True
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            size = f"{w}x{h}"
        at += 2 + n
        if marker == 0xDA:
            break
    end = data.find(b"\xff\xd9", at)
    if size is None:
        return None
    return Verdict("image", 100, "JPG", f"{size}, {'Contains Exif' if exif else 'No Exif'}", end + 2 if end >= 0 else 0)


def classify(data: bytes):
    return png(data) or gif(data) or jpg(data)
