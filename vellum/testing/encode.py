"""Encoder for note containers, from the byte layout alone: it shares no code with the decoders."""

from __future__ import annotations

import io
import struct
import zipfile
from dataclasses import dataclass, field

Rgb = tuple[int, int, int]
FAMILIES = (0x90, 0xA6, 0xE3, 0xE7, 0x1F6)


@dataclass
class Stroke:
    start: tuple[float, float] = (0.0, 0.0)
    deltas: list[tuple[int, int]] = field(default_factory=list)  # in 1/32, magnitudes up to 255
    channels: list[list[int]] = field(default_factory=list)  # up to four lists of steps
    box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    layout: str = "current"
    extra: int = 0
    marker: int | None = 2
    colour: Rgb | None = None
    width: float = 2.0
    declared: int | None = None


@dataclass
class Element:
    box: tuple[float, float, float, float]
    uuid: str = "01234567-89ab-cdef-0123-456789abcdef"
    text: str | None = None  # an image without one
    styles: bytes = b""


@dataclass
class Page:
    width: int = 1080
    height: int = 1527
    uuid: str = "page"
    base: int = 0xE3
    box: tuple[float, float, float, float] = (0.0, 0.0, 100.0, 100.0)
    background: Rgb | None = None
    template: int = 0
    strokes: list[Stroke] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    declared: int | None = None


def _signed(v: int) -> bytes:
    return bytes((abs(v), 0x80 if v < 0 else 0))


def stroke_data(s: Stroke) -> bytes:
    out = b"".join(_signed(dx) + _signed(dy) for dx, dy in s.deltas) + bytes(4)
    out += b"".join(_signed(v) for channel in s.channels for v in channel)
    if s.marker is not None:
        out += bytes((s.marker, 0, 1, 0, 0, 0))
        if s.colour:
            r, g, b = s.colour
            out += bytes((b, g, r, 0xFF))
        out += struct.pack("<f", s.width)
    return out


def stroke_bytes(s: Stroke) -> bytes:
    """Pre-record and stroke record."""
    pre = bytearray(71)
    pre[3] = 0x79 + s.extra
    data, n = stroke_data(s), len(s.deltas) + 1 if s.declared is None else s.declared
    box, start = struct.pack("<4d", *s.box), struct.pack("<2d", *s.start)
    if s.layout == "current":
        meta = bytearray(41)
        struct.pack_into("<I", meta, 21, len(data))
        struct.pack_into("<H", meta, 39, n)
        return bytes(pre) + box + bytes(s.extra) + bytes(meta) + start + data
    meta = bytearray(38)
    struct.pack_into("<I", meta, 21, len(data))
    struct.pack_into("<H", meta, 36, n)
    return bytes(pre) + box + bytes(meta) + start + data + bytes(3)


def style(tag: int, value: bytes, start: int = 0, end: int = 0) -> bytes:
    """One tagged style record of 24 bytes; value is placed at 18."""
    out = bytearray(18)
    out[0:4] = bytes((0x18, 0, tag & 0xFF, tag >> 8))
    struct.pack_into("<II", out, 6, start, end)
    return bytes(out) + value + bytes(max(0, 6 - len(value)))


def colour_style(tag: int, c: Rgb) -> bytes:
    return style(tag, bytes((c[2], c[1], c[0], 0xFF)))


def run_style(tag: int, start: int, end: int, on: bool = True) -> bytes:
    return style(tag, struct.pack("<I", on), start, end)


def element_bytes(e: Element) -> bytes:
    out = e.uuid.encode() + bytes(2) + struct.pack("<4d", *e.box)
    if e.text is None:
        return out + b"\x01\x00\x04\x20" + bytes(8)
    return out + b"\x01\x00" * 1 + e.text.encode("utf-16-le") + bytes(2) + e.styles + bytes(32)


def page_bytes(p: Page) -> bytes:
    out = bytearray(max(p.base + 0x6E, 0xC0))
    struct.pack_into("<I", out, 0, p.base)
    struct.pack_into("<II", out, 0x16, p.width, p.height)
    struct.pack_into("<H", out, 0x26, len(p.uuid))
    out[0x28 : 0x28 + 2 * len(p.uuid)] = p.uuid.encode("utf-16-le")
    struct.pack_into("<4d", out, 0x80, *p.box)
    if p.background:
        at = {0x90: 0x84, 0xA6: 0x80}.get(p.base, 0xA4)
        r, g, b = p.background
        out[at : at + 4] = bytes((b, g, r, 0xFF))
    if p.template:
        if p.base == 0xA6:
            struct.pack_into("<I", out, 0x8C, p.template << 16)
        else:
            struct.pack_into("<I", out, 0x8C if p.base == 0x90 else 0xAC if p.base >= 0xE7 else 0xB4, p.template)
    struct.pack_into("<I", out, p.base + 0x66, len(p.strokes) if p.declared is None else p.declared)
    return bytes(out) + b"".join(map(stroke_bytes, p.strokes)) + b"".join(map(element_bytes, p.elements))


def end_tag_bytes(created: int, modified: int) -> bytes:
    out = bytearray(0x90)
    struct.pack_into("<qq", out, 0x48, created, modified)
    return bytes(out)


def note_bytes(flags: int = 0, width: int = 0, height: int = 0, background: Rgb | None = None, text: str | None = None, styles: bytes = b"") -> bytes:
    out = bytearray(0x30)
    struct.pack_into("<I", out, 4, flags)
    struct.pack_into("<II", out, 0x28, width, height)
    if background:
        out += b"\x18\0\0\0\x01\0\0\0" + bytes(background) + b"\xff"
    out += bytes(2)
    if text is not None:
        out += text.encode("utf-16-le") + bytes(2) + styles
    return bytes(out) + bytes(32)


def registry_bytes(ids: list[str]) -> bytes:
    return bytes(0x20) + struct.pack("<H", len(ids)) + b"".join(struct.pack("<H", len(i)) + i.encode("utf-16-le") for i in ids)


def manifest_bytes(name: str, sha256: str) -> bytes:
    return bytes(0x0E) + struct.pack("<H", len(name)) + name.encode("utf-16-le") + sha256.encode() + bytes(9) + b"EOFX"


def container(entries: list[tuple[str, bytes]], stored: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as archive:
        for name, data in entries:
            archive.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def note(pages: list[Page], media: list[tuple[str, bytes]] = (), created: int = 0, modified: int = 0, **header) -> bytes:
    """A whole container."""
    entries = [("note.note", note_bytes(**header)), ("pageIdInfo.dat", registry_bytes([p.uuid for p in pages]))]
    entries += [(f"{i:04d}-{p.uuid}.page", page_bytes(p)) for i, p in enumerate(pages)]
    return container([*entries, *((f"media/{n}", d) for n, d in media), ("end_tag.bin", end_tag_bytes(created, modified))])
