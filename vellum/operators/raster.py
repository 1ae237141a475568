"""PNG images of the SVG that the renderer writes: rectangles, lines and polylines with round
caps, in anti-aliased scan lines. Text and embedded images are left out, as no font or image
library is at hand; the README lists this."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .notes import _decode

_SHAPE = re.compile(r"<(rect|line|polyline)\s([^>]*?)/?>")
_NAME = re.compile(r'([\w-]+)="([^"]*)"')
_SIZE = re.compile(r'<svg[^>]*?\swidth="([\d.]+)"[^>]*?\sheight="([\d.]+)"')


def _colour(text: str) -> np.ndarray:
    return np.array([int(text[i : i + 2], 16) for i in (1, 3, 5)], np.float32) if re.fullmatch(r"#[0-9a-fA-F]{6}", text) else np.zeros(3, np.float32)


def _segment(canvas: np.ndarray, a: tuple[float, float], b: tuple[float, float], width: float, colour: np.ndarray) -> None:
    """Blend by each pixel centre's distance from the segment."""
    reach = width / 2 + 1
    x0, x1 = int(max(0, min(a[0], b[0]) - reach)), int(min(canvas.shape[1], max(a[0], b[0]) + reach + 1))
    y0, y1 = int(max(0, min(a[1], b[1]) - reach)), int(min(canvas.shape[0], max(a[1], b[1]) + reach + 1))
    if x0 >= x1 or y0 >= y1:
        return
    px, py = np.arange(x0, x1) + 0.5 - a[0], (np.arange(y0, y1) + 0.5 - a[1])[:, None]
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = np.clip((px * dx + py * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
    far = np.hypot(px - t * dx, py - t * dy)
    cover = np.clip(width / 2 + 0.5 - far, 0, 1)[..., None].astype(np.float32)
    part = canvas[y0:y1, x0:x1]
    part += (colour - part) * cover


def png_bytes(rgb: np.ndarray) -> bytes:
    height, width, _ = rgb.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def rasterize(svg: str) -> bytes:
    """PNG of an SVG text; ValueError if it has no size."""
    size = _SIZE.search(svg)
    if not size or not (width := round(float(size[1]))) or not (height := round(float(size[2]))):
        raise ValueError("an SVG without a size")
    canvas = np.full((height, width, 3), 255, np.float32)
    for kind, attributes in _SHAPE.findall(svg):
        a = dict(_NAME.findall(attributes))
        if kind == "rect":
            x, y, w, h = (float(a.get(k, 0)) for k in ("x", "y", "width", "height"))
            canvas[max(0, round(y)) : max(0, round(y + h)), max(0, round(x)) : max(0, round(x + w))] = _colour(a.get("fill", ""))
            continue
        if kind == "line":
            points = [(float(a["x1"]), float(a["y1"])), (float(a["x2"]), float(a["y2"]))]
        else:
            points = [tuple(map(float, p.split(","))) for p in a["points"].split()]
        colour, pen = _colour(a.get("stroke", "")), float(a.get("stroke-width", 1))
        for p, q in zip(points, points[1:]):
            _segment(canvas, p, q, pen, colour)
    return png_bytes(np.rint(canvas).astype(np.uint8))


def page_png(svgs: DataFrame) -> DataFrame:
    """path, page_ordinal, png of the table of page_svg."""

    def draw(path, ordinal, svg) -> Iterator[tuple]:
        yield path, ordinal, rasterize(svg)

    return _decode(svgs.select("path", "page_ordinal", "svg"), "path string, page_ordinal int, png binary", draw, 4)
