"""The format's published test vectors, and properties against the independent encoder."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.functions import binary as B
from vellum.testing import encode as E


def h(text):
    return bytes.fromhex(text)


@pytest.mark.parametrize(
    "data, at, count, want",
    [("2A000A00", 0, 2, [42, 10]), ("2A800A80", 0, 2, [-42, -10]), ("050003800700", 0, 3, [5, -3, 7]), ("FFFF05000380", 2, 2, [5, -3]), ("050003", 0, 2, [5])],
)
def test_sign_magnitudes(data, at, count, want):
    assert B.sign_magnitudes(h(data), at, count).tolist() == want


@pytest.mark.parametrize(
    "data, start, deltas, want",
    [("2000400000002080", (10, 20), 2, [(10, 20), (11, 22), (11, 21)]), ("40802080", (5, 5), 1, [(5, 5), (3, 4)]), ("20054085", (0, 0), 1, [(0, 0), (1, -2)]), ("200040", (1, 1), 3, [(1, 1)])],
)
def test_coordinates(data, start, deltas, want):
    assert B.coordinates(h(data), start, deltas).tolist() == [list(map(float, p)) for p in want]


def blob(n, at, text, *more):
    out = bytearray(n)
    for a, raw in [(at, h(text)), *more]:
        out[a : a + len(raw)] = raw
    return bytes(out)


def test_pen():
    assert B.pen(blob(20, 4, "0300010000 0014A147FF"))[0] == (0x47, 0xA1, 0x14)
    assert B.pen(blob(20, 4, "01000100000014A147FF")) == (None, 0.8)
    colour, width = B.pen(blob(20, 4, "02000100000014A147FF", (14, struct.pack("<f", 5.54))))
    assert colour == (0x47, 0xA1, 0x14) and abs(width - 5.54) < 0.01
    colour, width = B.pen(blob(16, 2, "020001000000", (8, struct.pack("<f", 9.12))))
    assert colour is None and abs(width - 9.12) < 0.01


def test_pressure_channel():
    raw = B.channels(blob(100, 8, "640032001480"), 4, 3)
    assert B.pressures(raw[0]).tolist() == [100 / 1400, 150 / 1400, 130 / 1400]


def page(size, height, base, *pokes):
    out = bytearray(size)
    struct.pack_into("<I", out, 0, base)
    struct.pack_into("<II", out, 0x16, 1080, height)
    for at, raw in pokes:
        out[at : at + len(raw)] = raw
    return bytes(out)


u32 = lambda v: struct.pack("<I", v)


@pytest.mark.parametrize(
    "data, background, template",
    [
        (page(0xA8, 1527, 0, (0xA4, h("DDDDF5FF"))), (0xF5, 0xDD, 0xDD), None),
        (page(0x200, 1527, 0xE7, (0xA4, h("DDDACBFF")), (0xAC, u32(1))), (0xCB, 0xDA, 0xDD), (1, "BuiltIn", None)),
        (page(0x200, 1527, 0x90, (0x84, h("DDDACBFF")), (0x8C, u32(10))), (0xCB, 0xDA, 0xDD), (10, "BuiltIn", None)),
        (page(0x200, 1528, 0xA6, (0x80, h("DDDACBFF")), (0x8C, u32(3 << 16))), (0xCB, 0xDA, 0xDD), (3, "CustomPdf", 3)),
        (page(0x200, 1527, 0xE3, (0xA4, h("FCFCFCFF")), (0xAC, u32(1))), (0xFC, 0xFC, 0xFC), None),
    ],
)
def test_page_header(data, background, template):
    got = B.page_header(data)
    assert (got.background, got.template) == (background, template)


def test_page_errors():
    for data in (bytes(0x9F), E.page_bytes(E.Page(base=0x1F6))[:0x200], page(0xA0, 1, 0xE3)):
        with pytest.raises(B.NoteError):
            B.page_header(data)
    long_id = bytearray(0x200)
    struct.pack_into("<H", long_id, 0x26, 0xFFFF)
    with pytest.raises(B.NoteError):
        B.page_header(bytes(long_id))


def test_dark_mode():
    assert B.note_header(blob(0x30, 4, "04080000")).dark_mode is True
    assert B.note_header(blob(0x30, 4, "04000000")).dark_mode is False
    assert B.note_header(b"").dark_mode is None


def test_metadata():
    data = E.note_bytes(0x0800, 1848, 7838, (1, 2, 3), "Hello world", E.run_style(5, 0, 5) + E.colour_style(1, (9, 8, 7)))
    got = B.note_header(data)
    assert (got.dark_mode, got.dimensions, got.background) == (True, (1848, 7838), (1, 2, 3))
    text = B.note_text(data)
    assert "Hello world" in text.text and text.colour == (9, 8, 7) and text.box == (0, 0, 0, 0)
    assert B.end_tag(E.end_tag_bytes(-5, 7)) == (-5, 7) and B.end_tag(bytes(0x57)) == (None, None)
    assert B.page_ids(E.registry_bytes(["a", "bc", ""])) == ["a", "bc", ""]
    assert B.page_ids(E.registry_bytes(["a", "bcd"])[:-1]) == ["a"] and B.page_ids(b"x") == []
    assert B.media_manifest(E.manifest_bytes("1@a.png", "ab" * 32)) == ("1@a.png", "ab" * 32, True)


def test_background_needs_a_byte_behind_it():
    mark = h("1800000001000000 0A0B0CFF")
    assert B.note_header(mark).background is None
    assert B.note_header(mark + b"\0").background == (10, 11, 12)


def test_surrogates_are_not_paired():
    assert B.utf16_units("a😀".encode("utf-16-le")) == "a��"


delta = st.integers(-255, 255)


@st.composite
def strokes(draw):
    n = draw(st.integers(0, 12))
    layout = draw(st.sampled_from(["current", "shifted"]))
    channels = draw(st.lists(st.lists(delta, min_size=n, max_size=n), max_size=4))
    colour = draw(st.none() | st.tuples(*[st.integers(0, 255)] * 3))
    start = (float(draw(st.integers(0, 2000))), float(draw(st.integers(0, 2000))))
    extra = draw(st.integers(0, 134)) if layout == "current" else 0
    width = draw(st.sampled_from([0.5, 2.0, 7.25]))
    return E.Stroke(start, draw(st.lists(st.tuples(delta, delta), min_size=n, max_size=n)), channels, layout=layout, extra=extra, marker=draw(st.sampled_from([2, 3])), colour=colour, width=width)


@settings(max_examples=150, deadline=None)
@given(st.lists(strokes(), max_size=5), st.sampled_from(E.FAMILIES))
def test_strokes_round_trip(made, base):
    data = E.page_bytes(E.Page(base=base, strokes=made))
    header = B.page_header(data)
    frames, end = B.stroke_frames(data, header)
    assert [f.layout for f in frames] == [s.layout for s in made]
    assert end == len(data)
    for f, s in zip(frames, made):
        raw = data[f.data_at : f.data_at + f.data_bytes]
        want = np.cumsum(np.array([s.start, *[(dx / 32, dy / 32) for dx, dy in s.deltas]], float), axis=0)
        assert np.array_equal(B.coordinates(raw, f.start, f.deltas), want)
        got = B.channels(raw, 4 * f.deltas, f.deltas)
        for g, c in zip(got, s.channels):
            assert g.tolist() == np.cumsum(c).tolist()


def test_truncated_pages_keep_what_fits():
    made = [E.Stroke((i, i), [(1, 1)] * 3) for i in range(3)]
    data = E.page_bytes(E.Page(strokes=made, declared=9))
    assert len(B.stroke_frames(data, B.page_header(data))[0]) == 3
    assert len(B.stroke_frames(data[:-10], B.page_header(data))[0]) == 2


def test_declared_more_points_than_data():
    s = E.Stroke((1, 1), [(32, 0)] * 3, marker=None, declared=50)
    data = E.page_bytes(E.Page(strokes=[s]))
    (f,), _ = B.stroke_frames(data, B.page_header(data))
    assert f.deltas == 4  # three deltas and the gap
    assert all(len(c) == 0 for c in B.channels(data[f.data_at :], 4 * f.deltas, f.deltas))


def test_elements():
    runs = E.run_style(5, 0, 4) + E.run_style(6, 2, 6) + E.run_style(5, 3, 99)
    styles = E.colour_style(1, (1, 2, 3)) + E.colour_style(0x11, (4, 5, 6)) + E.style(3, struct.pack("<f", 17.0)) + runs
    made = [
        E.Element((10, 10, 100, 50)),
        E.Element((20, 20, 200, 90), text="Some text here", styles=styles),
        E.Element((10, 10, 100, 50), text="只有汉字没有别的"),
        E.Element((10, 60, 100, 90)),
        E.Element((30, 30, 35, 90)),
    ]
    data = E.page_bytes(E.Page(elements=made))
    got = B.page_elements(data, 0xE3 + 0x6E, 1080, 1527)
    assert [(k, m) for k, _, m, _ in got] == [("image", 0), ("text", None), ("image", 1)]
    text = got[1][3]
    assert text.text.endswith("Some text here") and text.colour == (1, 2, 3) and text.highlight == (4, 5, 6)
    assert text.font_size == 17.0 and text.underline  # an italic run also reads as underline
    assert text.runs[0][2:] == (True, False) and text.runs[-1][2:] == (False, True)
    assert B.page_elements(data, 0xE3 + 0x6E, 0, 0) == []


def test_font_near_the_end_is_none():
    for room in range(18, 30):
        B.style_size(bytes((0x18, 0, 3, 0)) + bytes(room - 4))


def naive_text(data):
    at = 0
    while at + 6 <= len(data):
        end, out = at, []
        while end + 2 <= len(data):
            u = data[end] | data[end + 1] << 8
            if not (u == 10 or 0x20 <= u <= 0xD7FF):
                break
            out.append(chr(u))
            end += 2
        if B.plausible_text("".join(out).strip()):
            return "".join(out), end
        at += 2
    return None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a\0", b"b\0", b" \0", b"\0\0", b"\n\0", b"\x11\x4e", b"\x22\x30", b"z"]), max_size=24))
def test_first_text_is_the_first(parts):
    data = b"".join(parts)
    assert B.first_text(data) == naive_text(data)


def naive_rotation(record, box):
    import math

    x0, y0, x1, y1 = box
    seen = []
    for at in range(max(0, len(record) - 16)):
        x, y = struct.unpack_from("<2d", record, at)
        if math.isfinite(x) and math.isfinite(y) and x0 - x1 <= x <= 2 * x1 and y0 - y1 <= y <= 2 * y1:
            seen.append((x, y))
    for (a, b), (c, d) in zip(seen, seen[1:]):
        if math.hypot(c - a, d - b) > 40 and 5 < abs(t := math.degrees(math.atan2(d - b, c - a))) < 85:
            return t
    return None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=4), st.binary(max_size=20))
def test_rotation(before, pts, after):
    record = before + b"".join(struct.pack("<2d", *map(float, p)) for p in pts) + after
    box = (10.0, 10.0, 200.0, 200.0)
    assert B.rotation(record, box) == naive_rotation(record, box)


def test_inspection():
    assert B.sniff(b"\x89PNG\r\n\x1a\nxx") == "png" and B.sniff(b"RIFF....WEBPx") == "webp" and B.sniff(b"\xff\xd8\xff\xe0") == "jpeg" and B.sniff(b"zz") is None
    assert B.ascii_strings(b"\0abcd\0ab\0") == [(1, "abcd")]
    assert B.utf16_strings(b"\0" + "xyz".encode("utf-16-le") + b"\xff") == [(1, "xyz")]
    assert B.footer(bytes(5) + b"Made by hand" + bytes(2)) == "Made by hand" and B.footer(b"abcdef\x01") is None
    rows = B.hex_dump(bytes(range(20)))
    assert len(rows) == 2 and rows[1].startswith("00000010  10 11 12 13")
    assert B.hex_dump(bytes(40), 16, 8) == ["00000010  00 00 00 00 00 00 00 00" + " " * 26 + "........"]
    assert B.read("I", b"abc", 0) is None and B.read("H", b"ab", 0) == 0x6261 and B.read("d", bytes(8), 1) is None
