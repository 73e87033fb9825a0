"""zlib streams: whole 100, cut short 75, broken none. Input and output are bounded by ``Limits``."""

import zlib

from strata.operators.classifiers import Limits, Verdict


def classify(data: bytes, limits: Limits = Limits()):  # noqa: B008  frozen
    data = data[: limits.zlib_input]
    d = zlib.decompressobj()
    out = d.decompress(data, len(data) * (limits.zlib_ratio or 0))
    used = len(data) - len(d.unused_data) - len(d.unconsumed_tail)
    if not out:
        return None
    note = " TRUNCATED" if not d.eof and d.unconsumed_tail else ""
    return Verdict("zlib", 100 if d.eof else 75, "ZLIB", f"zlib data, {len(out)} bytes{note}", used if len(out) > used else 0, "zlib", [("decompressed_zlib", out)])
