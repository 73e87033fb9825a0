"""zip, gzip, bzip2 and tar inside them; Office documents are zips with certain members."""

import bz2
import io
import struct
import tarfile
import zipfile
import zlib

from strata.operators.classifiers import Limits, Verdict

#: member names (fixed values)
OFFICE_NEEDS = {"[Content_Types].xml", "_rels/.rels"}
OFFICE_KINDS = [("word/document.xml", "DOCX"), ("xl/workbook.xml", "XLSX"), ("ppt/presentation.xml", "PPTX")]


def office_kinds(names) -> list[str]:
    have = set(names)
    return [kind for member, kind in OFFICE_KINDS if member in have] if have >= OFFICE_NEEDS else []


def _end_of_zip(data: bytes) -> int:
    """Where the archive that begins the data ends: behind the end record that lies right behind its own directory.

    Archives stored inside have end records too, but theirs count from their own beginning. 0 without one.
    """
    at = data.find(b"PK\x05\x06")
    while 0 <= at <= len(data) - 22:
        n, size, start, comment = struct.unpack_from("<HIIH", data, at + 10)
        if start + size == at and (data[start : start + 4] == b"PK\x01\x02" if n else not size):
            return at + 22 + comment
        at = data.find(b"PK\x05\x06", at + 4)
    return 0


def _zip(data: bytes, limits: Limits):
    end = _end_of_zip(data)
    if not end:
        return Verdict("compression", 60, "ZIP", "ZIP archive CORRUPTED", 0, "compressed")
    z = zipfile.ZipFile(io.BytesIO(data[:end]))
    children, note, confidence = [], "", 100
    for m in z.infolist():
        if m.flag_bits & 1:
            note = " PASSWORD PROTECTED"
        elif m.file_size:
            try:
                with z.open(m) as f:
                    children.append((m.filename, f.read(limits.child_bytes)))
                if len(children[-1][1]) < m.file_size:
                    note = note or " TRUNCATED"
            except (zipfile.BadZipFile, zlib.error, NotImplementedError):
                note, confidence = " CORRUPTED", 70
    kinds = office_kinds(z.namelist())
    brief = "/".join(kinds) if kinds else "ZIP"
    return Verdict("compression", confidence, brief, ("OfficeX Document" if kinds else "ZIP archive") + note, end, "compressed", children)


def unfold(d, data: bytes, most: int | None) -> tuple[bytes, bool]:
    """What a decompressor makes of the data, up to ``most`` bytes, and whether there is more. It is run to the
    stream's end in any case, a megabyte at a time behind the bound, so that end and soundness are known."""
    out, cut = d.decompress(data, most or 0) if most else d.decompress(data), False
    while most and not d.eof:
        more = d.decompress(getattr(d, "unconsumed_tail", b""), 1 << 20)
        if not more:
            break
        if len(out) < most:
            out, more = out + more[: most - len(out)], more[most - len(out) :]
        cut = cut or bool(more)
    return out, cut


def _stream(data: bytes, kind: str, d, limits: Limits):
    if kind == "BZIP" and limits.child_bytes is None:
        out, cut = d.decompress(data), False
    else:
        out, cut = unfold(d, data, limits.child_bytes)
    used = len(data) - len(d.unused_data)
    confidence, note = (100, " TRUNCATED" if cut else "") if d.eof else (70, " CORRUPTED")
    children = [("data", out)]
    if out[257:262] == b"ustar":
        try:
            with tarfile.open(fileobj=io.BytesIO(out)) as t:
                children = [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
        except tarfile.TarError:
            if not cut:
                confidence, note = 70, " CORRUPTED"
    return Verdict("compression", confidence, kind, f"{kind} data{note}", used if d.eof else 0, "compressed", children)


def classify(data: bytes, limits: Limits = Limits()):  # noqa: B008  frozen
    if data[:4] == b"PK\x03\x04":
        return _zip(data, limits)
    if data[:2] == b"\x1f\x8b":
        return _stream(data, "GZIP", zlib.decompressobj(31), limits)
    if data[:3] == b"BZh":
        return _stream(data, "BZIP", bz2.BZ2Decompressor(), limits)
    return None


__all__ = ["classify", "office_kinds"]
