"""Sizes and formats from the headers of image files, by the public format descriptions."""

from __future__ import annotations

import struct


def read_header(content: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height), all None if the content is none of PNG, JPEG, BMP, TIFF and WEBP or is cut off before its size."""
    none = (None, None, None)
    if not content:
        return none
    b = bytes(content)
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return ("PNG", *struct.unpack(">II", b[16:24]))
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            return "BMP", w, abs(h)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
        if b[:4] in (b"II*\x00", b"MM\x00*"):
            return _tiff(b)
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
    except (struct.error, IndexError):
        pass
    return none


def _jpeg(b: bytes) -> tuple[str | None, int | None, int | None]:
    at = 2
    while at < len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return "JPEG", w, h
        if mark in (0x01, *range(0xD0, 0xDA)):
            at += 2
            continue
        at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None, None, None


def _tiff(b: bytes) -> tuple[str | None, int | None, int | None]:
    e = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(e + "I", b[4:8])[0]
    found = {}
    for i in range(struct.unpack(e + "H", b[at : at + 2])[0]):
        tag, kind, _, raw = struct.unpack(e + "HHI4s", b[at + 2 + 12 * i : at + 14 + 12 * i])
        if tag in (256, 257):
            found[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
    return ("TIFF", found[256], found[257]) if len(found) == 2 else (None, None, None)


def _webp(b: bytes) -> tuple[str | None, int | None, int | None]:
    kind = b[12:16]
    if kind == b"VP8X":
        return "WEBP", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", b[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L":
        v = struct.unpack("<I", b[21:25])[0]
        return "WEBP", (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1
    return None, None, None
