"""PDF by scanning: end marker 50, encrypted 75, with pages 100. Streams are handed on as they are stored."""

import re

from strata.operators.classifiers import Verdict

MAX_STREAMS = 4096
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")


def classify(data: bytes):
    at = data.find(b"%PDF", 0, 1024)
    end = data.find(b"%%EOF", max(at, 0))
    if at < 0 or end < 0:
        return None
    again = data.find(b"%%EOF", end + 5)  # a file that was saved again has a second marker
    end = (again if again >= 0 else end) + 5
    body = data[at:end]
    pages = len(PAGE.findall(body))
    streams = [m[1] for _, m in zip(range(MAX_STREAMS), STREAM.finditer(body), strict=False)]
    children = [(str(i), s) for i, s in enumerate(streams)]
    if b"/Encrypt" in body:
        return Verdict("pdf", 75, "PDF", "Encrypted PDF document", end, "pdf", children)
    if pages:
        return Verdict("pdf", 100, "PDF", f"Valid PDF document. {pages} pages", end, "pdf", children)
    return Verdict("pdf", 50, "PDF", "PDF document", end, "pdf", children)
