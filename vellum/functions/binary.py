"""Decoders for the bytes of a note container's entries. Integers are little-endian.

Each takes a whole entry and returns plain Python or numpy values; missing and truncated fields
are None or empty. They run inside Arrow stages, one entry at a time, as stroke records can only
be found one after the other.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
COORDINATE_STEP = 1 / 32
PRESSURE_FULL = 1400.0
DEFAULT_PEN_WIDTH = 0.8
RECORD_BYTES, STROKE_BYTES = 71, 89
EXTRA_BIAS = 0x79
DARK_MODE_FLAG = 0x0800
CURRENT, SHIFTED = "current", "shifted"
COLOUR_TAG, FONT_TAG, BOLD_TAG, ITALIC_TAG, UNDERLINE_TAG, HIGHLIGHT_TAG = 0x01, 0x03, 0x05, 0x06, 0x07, 0x11
IMAGE_MARK = b"\x01\x00\x04\x20"
TRAILER_MARK = b"EOFX"

Rgb = tuple[int, int, int]
Box = tuple[float, float, float, float]

_BACKGROUND = re.compile(rb"(?=\x18\0\0\0\x01\0\0\0(.)(.)(.)\xff)", re.S)
_PEN = re.compile(rb"(?=[\x02\x03]\0\x01\0\0\0)")
_UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_ASCII = re.compile(rb"[\x20-\x7e]{4,}")
_MAGIC = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"BM", "bmp"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"))


class NoteError(ValueError):
    """An entry that can't be a page."""


def read(kind: str, data: bytes, at: int) -> int | float | None:
    """One value of a struct code (H, I, q, f, d) at a byte offset; None beyond the end."""
    return struct.unpack_from("<" + kind, data, at)[0] if 0 <= at and at + struct.calcsize("<" + kind) <= len(data) else None


def utf16_units(data: bytes) -> str:
    """Each unit on its own: surrogates become U+FFFD, and pairs aren't joined."""
    units = np.frombuffer(data, "<u2", len(data) // 2)
    return "".join("�" if 0xD800 <= u < 0xE000 else chr(u) for u in units.tolist())


# metadata entries ------------------------------------------------------------------------


def end_tag(data: bytes) -> tuple[int | None, int | None]:
    """Created and modified, in milliseconds since 1970."""
    return struct.unpack_from("<qq", data, 0x48) if len(data) >= 0x58 else (None, None)


@dataclass
class NoteHeader:
    dark_mode: bool | None = None
    dimensions: tuple[int, int] | None = None
    background: Rgb | None = None


def note_header(data: bytes) -> NoteHeader:
    found = NoteHeader()
    if len(data) >= 8:
        found.dark_mode = bool(read("I", data, 4) & DARK_MODE_FLAG)
    if len(data) >= 0x30 and all(size := struct.unpack_from("<II", data, 0x28)):
        found.dimensions = size
    # the pattern counts only where a byte follows it; here the order is R, G, B
    if match := next((m for m in _BACKGROUND.finditer(data) if m.start() + 12 < len(data)), None):
        found.background = match[1][0], match[2][0], match[3][0]
    return found


def page_ids(data: bytes) -> list[str]:
    ids: list[str] = []
    at = 0x22
    for _ in range(read("H", data, 0x20) if len(data) >= 0x24 else 0):
        size = read("H", data, at)
        if size is None or at + 2 + 2 * size > len(data):
            break
        ids.append(utf16_units(data[at + 2 : at + 2 + 2 * size]))
        at += 2 + 2 * size
    return ids


def media_manifest(data: bytes) -> tuple[str, str, bool] | None:
    """Name, SHA-256 in hex, and whether the trailer mark ends the entry."""
    size = read("H", data, 0x0E)
    if size is None or 0x10 + 2 * size + 64 > len(data):
        return None
    at = 0x10 + 2 * size
    return utf16_units(data[0x10:at]), data[at : at + 64].decode("ascii", "replace"), data.endswith(TRAILER_MARK)


def footer(data: bytes) -> str | None:
    """The last run of four or more printable characters, if it ends the entry but for zeros."""
    runs = list(_ASCII.finditer(data))
    return runs[-1][0].decode() if runs and not data[runs[-1].end() :].strip(b"\0") else None


def ascii_strings(data: bytes, least: int = 4) -> list[tuple[int, str]]:
    return [(m.start(), m[0].decode()) for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)]


def utf16_strings(data: bytes, least: int = 3) -> list[tuple[int, str]]:
    """Runs of UTF-16 units that are printable ASCII, at any byte offset."""
    return [(m.start(), m[0][::2].decode()) for m in re.finditer(rb"(?:[\x20-\x7e]\0){%d,}" % least, data)]


def sniff(data: bytes) -> str | None:
    """Kind of an image by its first bytes."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return next((kind for magic, kind in _MAGIC if data.startswith(magic)), None)


def hex_dump(data: bytes, offset: int = 0, limit: int = 0) -> list[str]:
    """Sixteen bytes a row: offset, hex, printable characters."""
    part = data[offset : offset + limit] if limit else data[offset:]
    rows = []
    for at in range(0, len(part), 16):
        row = part[at : at + 16]
        rows.append(f"{offset + at:08x}  {row.hex(' '):<47}  {''.join(chr(b) if 32 <= b < 127 else '.' for b in row)}")
    return rows


# pages -----------------------------------------------------------------------------------


@dataclass
class PageHeader:
    base: int
    width: int
    height: int
    uuid: str
    content_box: Box
    background: Rgb | None
    template: tuple[int, str, int | None] | None
    declared: int


def page_header(data: bytes) -> PageHeader:
    if len(data) < 0xA0:
        raise NoteError("page file too short for header")
    base, width, height = (read("I", data, at) for at in (0, 0x16, 0x1A))
    size = read("H", data, 0x26)
    if 0x28 + 2 * size > len(data):
        raise NoteError("page file too short for its id")
    declared = read("I", data, base + 0x66)
    if declared is None:
        raise NoteError("page file too short for stroke count")
    background = _bgr(data, {0x90: 0x84, 0xA6: 0x80}.get(base, 0xA4))
    template = _template(data, base) if background else None
    return PageHeader(base, width, height, utf16_units(data[0x28 : 0x28 + 2 * size]), struct.unpack_from("<4d", data, 0x80), background, template, declared)


def _bgr(data: bytes, at: int) -> Rgb | None:
    """A colour that its fourth byte confirms."""
    return (data[at + 2], data[at + 1], data[at]) if at + 4 <= len(data) and data[at + 3] == 0xFF else None


def _template(data: bytes, base: int) -> tuple[int, str, int | None] | None:
    if base == 0xA6:
        field = read("I", data, 0x8C)
        return None if field is None else (field >> 16, "CustomPdf", field >> 16)
    number = read("I", data, 0x8C if base == 0x90 else 0xAC if base >= 0xE7 else 0xB4)
    return (number, "BuiltIn", None) if number is not None and 1 <= number <= 0xFFFF else None


@dataclass
class StrokeFrame:
    layout: str
    box: Box
    start: tuple[float, float]
    declared_points: int
    data_at: int
    data_bytes: int
    next_record: int

    @property
    def deltas(self) -> int:
        """Coordinate pairs that the data hold; a stroke has one point more."""
        return min(self.declared_points - 1, self.data_bytes // 4)


def _frame(data: bytes, at: int, extra: int, layout: str) -> StrokeFrame | None:
    meta, points_at, start_at, gap = (at + 32 + extra, 39, at + 73 + extra, 0) if layout == CURRENT else (at + 32, 36, at + 70, 3)
    size, points = read("I", data, meta + 21), read("H", data, meta + points_at)
    start = read("d", data, start_at), read("d", data, start_at + 8)
    if not size and size != 0 or not points or None in start or not all(map(math.isfinite, start)):
        return None
    end = start_at + 16 + size
    if end > len(data):
        return None
    return StrokeFrame(layout, struct.unpack_from("<4d", data, at), start, points, start_at + 16, size, end + gap)


def stroke_frames(data: bytes, header: PageHeader) -> tuple[list[StrokeFrame], int]:
    """The strokes' places, and the offset at which they end. Each record says where the next one
    is; of two readings the shifted one wins only with more points. A record that fits neither
    ends the list, however many strokes the page declares."""
    frames: list[StrokeFrame] = []
    record = header.base + 0xB5 - RECORD_BYTES
    while len(frames) < header.declared:
        extra = max(0, data[record + 3] - EXTRA_BIAS) if record + 3 < len(data) else 0
        at = record + RECORD_BYTES
        if at + STROKE_BYTES + extra > len(data):
            break
        readings = [f for f in (_frame(data, at, extra, CURRENT), _frame(data, at, extra, SHIFTED)) if f]
        if not readings:
            break
        best = max(readings, key=lambda f: f.deltas)  # the first of equals
        record = best.next_record
        frames.append(best)
    return frames, record


def sign_magnitudes(data: bytes, at: int, count: int) -> np.ndarray:
    """Pairs of magnitude and flag; any flag but 0 is a minus."""
    pairs = np.frombuffer(data, np.uint8, max(0, min(2 * count, len(data) - at)) // 2 * 2, at).reshape(-1, 2).astype(np.int64)
    return np.where(pairs[:, 1] == 0, pairs[:, 0], -pairs[:, 0])


def coordinates(data: bytes, start: tuple[float, float], deltas: int) -> np.ndarray:
    """Points (n, 2): running sums of quartets dx, flag, dy, flag, whose sign is the flag's top bit."""
    n = max(0, min(deltas, len(data) // 4))
    q = np.frombuffer(data, np.uint8, 4 * n).reshape(n, 4).astype(np.float64)
    steps = np.where(q[:, 1::2] < 128, q[:, ::2], -q[:, ::2]) * COORDINATE_STEP
    return np.cumsum(np.vstack([np.array([start], np.float64), steps]), axis=0)


def channels(data: bytes, coordinate_bytes: int, count: int) -> list[np.ndarray]:
    """Pressure, time, tilt x and tilt y as running sums from 0, one value for each step. A
    channel that the data can't hold in full is empty."""
    out = []
    for k in range(4):
        at = coordinate_bytes + 4 + 2 * k * count
        fits = at + 2 * count <= len(data)
        out.append(np.cumsum(sign_magnitudes(data, at, count)) if fits else np.empty(0, np.int64))
    return out


def pressures(raw: np.ndarray) -> np.ndarray:
    return np.clip(raw / PRESSURE_FULL, 0.0, 1.0)


def pen(data: bytes) -> tuple[Rgb | None, float]:
    """Colour and width behind the last pen marker."""
    mark = max((m.start() for m in _PEN.finditer(data)), default=None)
    if mark is None:
        return None, DEFAULT_PEN_WIDTH
    colour = _bgr(data, mark + 6)
    width = read("f", data, mark + 10 if colour else mark + 6)
    return colour, DEFAULT_PEN_WIDTH if width is None else width


# objects and rich text -------------------------------------------------------------------


def uuid_offsets(data: bytes, start: int) -> list[int]:
    return [m.start() for m in _UUID.finditer(data, start)]


def plausible_box(box: Box, width: int, height: int) -> bool:
    x0, y0, x1, y1 = box
    return all(map(math.isfinite, box)) and min(x0, y0) >= 1 and x1 - x0 > 8 and y1 - y0 > 8 and x1 <= width * 1.25 and y1 <= height * 1.25


def object_box(data: bytes, uuid_at: int, width: int, height: int) -> Box | None:
    """The first plausible box from the end of the id on, within 128 bytes of its start."""
    for at in range(uuid_at + 36, min(uuid_at + 128, max(0, len(data) - 32)) + 1):
        if at + 32 > len(data):
            return None
        if plausible_box(box := struct.unpack_from("<4d", data, at), width, height):
            return box
    return None


def plausible_text(text: str) -> bool:
    """Three characters that aren't white space, three quarters of all such in ASCII."""
    solid = [c for c in text if not c.isspace()]
    return len(solid) >= 3 and 4 * sum("!" <= c <= "~" for c in solid) >= 3 * len(solid)


def first_text(data: bytes) -> tuple[str, int] | None:
    """The first UTF-16 text at an even offset that is plausible, and the offset of its end.

    A text is a run of printable units and line feeds up to its end; if a run is not plausible,
    its own later beginnings are tried. Counts from each beginning on come from one pass.
    """
    units = np.frombuffer(data, "<u2", len(data) // 2)
    shown = (units == 10) | (units >= 0x20) & (units <= 0xD7FF)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], shown, [False]]).astype(np.int8)))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        run = "".join(map(chr, units[first:last].tolist()))
        solid = np.array([not c.isspace() for c in run])
        common = np.array(["!" <= c <= "~" for c in run])
        total, ascii_ = (np.cumsum(x[::-1])[::-1] for x in (solid, common))
        fine = np.flatnonzero((total >= 3) & (4 * ascii_ >= 3 * total) & (2 * np.arange(first, last) + 6 <= len(data)))
        if len(fine):
            return run[fine[0] :], 2 * last
    return None


def tagged(styles: bytes, tag: int, room: int) -> Iterator[int]:
    """Offsets of a style tag's records that more than `room` bytes remain from."""
    mark = bytes((0x18, 0, tag & 0xFF, tag >> 8))
    at = styles.find(mark)
    while 0 <= at < len(styles) - room:
        yield at
        at = styles.find(mark, at + 1)


def style_colour(styles: bytes, tag: int) -> Rgb | None:
    return next((c for at in tagged(styles, tag, 22) if (c := _bgr(styles, at + 18))), None)


def style_number(styles: bytes, tag: int) -> int | None:
    at = next(tagged(styles, tag, 22), None)
    return None if at is None else read("I", styles, at + 18)


def style_size(styles: bytes, tag: int = FONT_TAG) -> float | None:
    """The first finite value in [4, 96] at one of three places of a record."""
    for at in tagged(styles, tag, 24):
        for place in (18, 20, 24):
            value = read("f", styles, at + place)
            if value is not None and 4 <= value <= 96:
                return value
    return None


def style_runs(styles: bytes, length: int, room: int) -> list[tuple[int, int, bool, bool]]:
    """start, end, bold, italic: the bold runs first. room: 18 in pages, 22 in the note's body,
    which therefore doesn't take a record that ends with the data."""
    runs = []
    for tag in (BOLD_TAG, ITALIC_TAG):
        for at in tagged(styles, tag, room):
            start, end, on = read("I", styles, at + 6), read("I", styles, at + 10), read("I", styles, at + 18)
            if on and start < end <= length:
                runs.append((start, end, tag == BOLD_TAG, tag == ITALIC_TAG))
    return runs


def rotation(record: bytes, box: Box) -> float | None:
    """Degrees between the first two successive points near the box that are over 40 apart and
    neither level nor upright. Every byte offset may start a point."""
    n = max(0, len(record) - 16)
    if not n:
        return None
    at_byte = np.empty(n + 8)
    for s in range(8):
        part = np.frombuffer(record[s:], "<f8", (len(record) - s) // 8)
        at_byte[s::8] = part[: len(at_byte[s::8])]
    x, y = at_byte[:n], at_byte[8 : n + 8]
    with np.errstate(invalid="ignore"):
        x0, y0, x1, y1 = box
        near = np.isfinite(x) & np.isfinite(y) & (x >= x0 - x1) & (x <= 2 * x1) & (y >= y0 - y1) & (y <= 2 * y1)
    px, py = x[near].tolist(), y[near].tolist()
    for i in range(1, len(px)):
        dx, dy = px[i] - px[i - 1], py[i] - py[i - 1]
        if math.hypot(dx, dy) > 40 and 5 < abs(degrees := math.degrees(math.atan2(dy, dx))) < 85:
            return degrees
    return None


@dataclass
class TextBox:
    box: Box
    rotation: float | None
    text: str
    colour: Rgb | None
    highlight: Rgb | None
    underline: bool
    font_size: float | None
    runs: list[tuple[int, int, bool, bool]]


def text_box(record: bytes, box: Box) -> TextBox | None:
    found = first_text(record)
    if found is None:
        return None
    text, end = found
    styles = record[end:]
    underline = bool(style_number(styles, UNDERLINE_TAG)) or bool(style_number(styles, ITALIC_TAG))
    return TextBox(box, rotation(record, box), text, style_colour(styles, COLOUR_TAG), style_colour(styles, HIGHLIGHT_TAG), underline, style_size(styles), style_runs(styles, len(text), 18))


def note_text(data: bytes) -> TextBox | None:
    """The typed body of a note: a box of zeros, and fewer styles."""
    found = first_text(data)
    if found is None:
        return None
    text, end = found
    styles = data[end:]
    return TextBox((0.0, 0.0, 0.0, 0.0), None, text, style_colour(styles, COLOUR_TAG), None, False, style_size(styles), style_runs(styles, len(text), 22))


def page_elements(data: bytes, start: int, width: int, height: int) -> list[tuple[str, Box, int | None, TextBox | None]]:
    """kind, box, media index, text box. Images are numbered on their page."""
    found, images = [], 0
    offsets = uuid_offsets(data, start)
    for at, until in zip(offsets, offsets[1:] + [len(data)]):
        box = object_box(data, at, width, height)
        if box is None:
            continue
        record = data[at:until]
        if text := text_box(record, box):
            found.append(("text", box, None, text))
        elif IMAGE_MARK in record:
            found.append(("image", box, images, None))
            images += 1
    return found
