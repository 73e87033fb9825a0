"""Token ids of whole texts through the tokenizers library, one distinct chunk at a time.

A tokenizer whose normalizer and pre-tokenizer never look across white space gives a text the ids of its
white-space separated chunks in a row. ``ChunkEncoder`` therefore hands the library each chunk it has not
met lately and joins remembered ids for the rest. Texts that hold one of the tokenizer's added tokens,
or white space beyond the six ASCII characters, are handed to the library whole.

Cases: null and empty texts have no ids of their own; texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import binary_array, pieces, texts, trim

#: White space beyond ASCII, and characters that a normalizer could join to what stands before them.
UNUSUAL_ASCII = re.compile(rb"[\x1c-\x1f]")
UNUSUAL = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others take code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class Parts(dict):
    """Pre-token to its ids as bytes, from the library's model: chunks that differ in punctuation or case share them."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.tokenize, self.limit, self.letters = model.tokenize, limit, byte_letters()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        mapped = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        out = self[part] = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
        return out


class ChunkEncoder(dict):
    """Chunk (bytes) to its ids as little-endian unsigned 32-bit bytes; remembers ``limit`` chunks at most.

    Where the tokenizer is a byte-level BPE over matches of one pattern, a new chunk goes to the library's
    normalizer and model directly, which skips what the library does for offsets; else to the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        steps = (layout.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norm = [x["type"] for x in (layout.get("normalizer") or {}).get("normalizers", [])]
        self.find = None
        if [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["add_prefix_space"] and norm == ["NFC", "Replace", "Lowercase"]:
            self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.parts = Parts(self.tokenizer.model, limit)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = chunk.decode()
        if self.find is None:
            out = self.whole(text)
        else:
            text = text.lower() if chunk.isascii() else self.tokenizer.normalizer.normalize_str(text)
            out = self.parts[text] if chunk.isalpha() else b"".join(map(self.parts.__getitem__, self.find(text)))
        self[chunk] = out
        return out

    def batch(self, rows: list[bytes]) -> list[bytes]:
        out = []
        for r in rows:
            if any(a in r for a in self.added) or not r.isascii() and UNUSUAL.search(r.decode()) or UNUSUAL_ASCII.search(r):
                out.append(self.whole(r.decode()))
            else:
                # A-Z go first where the tokenizer lower-cases anyway: fewer distinct chunks
                out.append(b"".join(map(self.__getitem__, (r.lower() if self.find else r).split())))
        return out


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, limit: int = 600_000) -> ChunkEncoder:
    """One encoder per worker process: what a task has learned serves the next one."""
    return ChunkEncoder(path, limit)


def token_ids(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, chunks: int = 600_000) -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit) of every text, with ``end_id`` after each where given.

    A worker remembers at most ``chunks`` distinct chunks and as many parts of them.
    """
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = worker_encoder(tokenizer_path, chunks)
        for b in pieces(batches):
            ids = [x + end for x in encoder.batch(texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), binary_array(ids)], names=["id", "ids"])
        trim()

    kept = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, ids binary")
