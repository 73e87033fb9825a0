"""JBIG1 by its 20-byte header."""

import struct

from strata.operators.classifiers import Verdict

MAX_BYTES = 104_857_600


def classify(data: bytes):
    if not 20 <= len(data) <= MAX_BYTES:
        return None
    low, high, planes, fill, w, h, stripe = struct.unpack_from(">BBBBIII", data)
    if low > high or not planes or fill or not (w and h and stripe) or w > 1 << 20 or h > 1 << 20:
        return None
    return Verdict("jbig", 100, "JBIG", f"{len(data)}B, {w}x{h}, {planes} plane(s)", len(data))
