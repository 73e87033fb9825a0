"""Audio and video by their headers; MP3 frames are followed from the first on."""

import struct

from strata.operators.classifiers import Verdict

#: kbit/s by index, MPEG-1 layer III (fixed values)
BITRATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0]
RATES = [44100, 48000, 32000, 0]
MAX_MISSES = 10_000


def mp3(data: bytes):
    at, frames, misses, first, end = 0, 0, 0, None, 0
    while at + 4 <= len(data) and misses <= MAX_MISSES:
        h = struct.unpack_from(">I", data, at)[0]
        bitrate, rate = BITRATES[h >> 12 & 15], RATES[h >> 10 & 3]
        if h >> 21 == 0x7FF and h >> 17 & 3 == 1 and bitrate and rate:
            if first is None:
                first = at
            at += 144_000 * bitrate // rate + (h >> 9 & 1)
            frames, misses, end = frames + 1, 0, min(at, len(data))
        else:
            if first is not None:
                break
            at, misses = at + 1, misses + 1
    if not frames:
        return None
    return Verdict("video", 25 if frames < 2 else 100, "AUDIO (MP3)", f"mp3, {frames} frame(s)", end)


def classify(data: bytes):
    if data[:4] == b"RIFF" and data[8:12] in (b"AVI ", b"WAVE"):
        n = struct.unpack_from("<I", data, 4)[0] + 8
        return Verdict("video", 100, "VIDEO (AVI)" if data[8:12] == b"AVI " else "AUDIO (WAVE)", f"riff, {n} bytes", n)
    if data[:4] == bytes.fromhex("3026B275"):
        return Verdict("video", 80, "VIDEO (WMV)", "asf")
    if data[:3] == b"FLV" and len(data) > 4 and data[4] & 5:
        return Verdict("video", 80, "VIDEO (FLV)" if data[4] & 1 else "AUDIO (FLV)", "flv")
    if data[:4] == b"ADIF":
        return Verdict("video", 80, "AUDIO (AAC)", "aac")
    if data[:3] == b"\0\0\1" and len(data) > 3 and data[3] >> 4 == 0xB:
        return Verdict("video", 80, "VIDEO (MPEG)", "mpeg")
    if data[:1] == b"\x47" and data[188:189] == b"\x47":
        return Verdict("video", 80, "VIDEO (MPEG)", "mpeg transport stream")
    return mp3(data)
