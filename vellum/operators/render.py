"""SVG pages: one fragment per stroke and element, put together in drawing order.

Numbers in fragments have two decimals rounded as IEEE formatting does, which Spark's
format_string doesn't, so fragments are made in an Arrow stage; colours, backgrounds, joins to
media and the assembly are DataFrame operations.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .notes import _decode


def _number(v: float) -> str:
    """Shortest decimal form of a double, whole numbers without a fraction."""
    return str(int(v)) if float(v).is_integer() else repr(float(v))


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _hex(c: dict | None, default: str) -> str:
    return default if c is None else f"#{c['r']:02x}{c['g']:02x}{c['b']:02x}"


def _clamped(v: float | None, scale: float, low: float, high: float, default: float) -> float:
    v = math.nan if v is None else v * scale
    return min(max(v, low), high) if math.isfinite(v) and v > 0 else default


def stroke_svg(points: list[dict], pressures: list[float], colour: str, width: float) -> str:
    """A line per segment if there is pressure, else one polyline; empty for a single point."""
    if len(points) < 2:
        return ""
    base = _clamped(width, 1 / 2.5, 0.4, 12.0, 1.0)
    if len(pressures) >= len(points) - 1 and any(p > C.PRESSED for p in pressures):
        out = []
        for j, (a, b) in enumerate(zip(points, points[1:])):
            w = base * (0.3 + 0.7 * max(pressures[min(j, len(pressures) - 1)], 0.05))
            out.append(f'  <line x1="{a["x"]:.2f}" y1="{a["y"]:.2f}" x2="{b["x"]:.2f}" y2="{b["y"]:.2f}" stroke="{colour}" stroke-width="{w:.2f}" stroke-linecap="round"/>\n')
        return "".join(out)
    places = " ".join(f"{p['x']:.2f},{p['y']:.2f}" for p in points)
    return f'  <polyline points="{places}" fill="none" stroke="{colour}" stroke-width="{base:.2f}" stroke-linecap="round" stroke-linejoin="round"/>\n'


def image_svg(box: dict, mime: str, data: bytes) -> str:
    w, h = box["x_max"] - box["x_min"], box["y_max"] - box["y_min"]
    return f'  <image x="{box["x_min"]:.2f}" y="{box["y_min"]:.2f}" width="{w:.2f}" height="{h:.2f}" href="data:{mime};base64,{base64.b64encode(data).decode()}" preserveAspectRatio="none"/>\n'


def styled_spans(line: str, start: int, runs: list[dict]) -> list[tuple[str, bool, bool]]:
    n = len(line)
    clip = lambda v: min(max(v - start, 0), n)
    cuts = [(clip(r["start"]), clip(r["end"])) for r in runs]
    edges = sorted({0, n, *(e for a, b in cuts if a < b for e in (a, b))})
    out = []
    for a, b in zip(edges, edges[1:]):
        over = [r for r in runs if r["start"] < start + b and r["end"] > start + a]
        out.append((line[a:b], any(r["bold"] for r in over), any(r["italic"] for r in over)))
    return out


def text_svg(box: dict, page_width: int, page_height: int) -> str:
    """A group with an optional highlight and one text element per line that isn't empty."""
    text = box["text"].rstrip("\n")
    if not text.strip():
        return ""
    b = box["bbox"]
    if b["x_max"] <= b["x_min"] or b["y_max"] <= b["y_min"]:
        x, y, w, h = 50.0, 0.0, page_width - 100.0, float(page_height)
    else:
        x, y, w, h = b["x_min"], b["y_min"], b["x_max"] - b["x_min"], b["y_max"] - b["y_min"]
    size = C.DEFAULT_FONT if box["font_size"] is None else _clamped(box["font_size"], 2.18, 8.0, 96.0, C.DEFAULT_FONT)
    turn = box["rotation_degrees"]
    out = [f"  <g{'' if turn is None else f' transform="rotate({turn:.2f} {x + w / 2:.2f} {y + h / 2:.2f})"'}>\n"]
    if box["highlight_color"] is not None:
        out.append(f'    <rect x="{x:.2f}" y="{y:.2f}" width="{w:.2f}" height="{h:.2f}" fill="{_hex(box["highlight_color"], "")}"/>\n')
    colour, under = _hex(box["color"], C.TEXT_COLOUR), ' text-decoration="underline"' if box["underline"] else ""
    start = 0
    for i, line in enumerate(text.split("\n")):
        line = line.removesuffix("\r")
        if line:
            out.append(f'    <text x="{x:.2f}" y="{y + size + i * (size * C.LINE):.2f}" fill="{colour}" font-family="Arial, sans-serif" font-size="{size:.2f}"{under}>')
            for part, bold, italic in styled_spans(line, start, box["runs"]):
                out.append(f"<tspan{' font-weight="bold"' if bold else ''}{' font-style="italic"' if italic else ''}>{_escape(part)}</tspan>")
            out.append("</text>\n")
        start += len(line) + 1
    return "".join(out) + "  </g>\n"


def svg_open(width: int, height: int, paper: str) -> str:
    w, h = float(width), float(height)
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0.0 0.0 {w:.1f} {h:.1f}" width="{width}" height="{height}">\n'
        f'  <rect x="0" y="0" width="{_number(w)}" height="{_number(h)}" fill="{paper}"/>\n'
    )


def page_svg(pages: DataFrame, documents: DataFrame, strokes: DataFrame, elements: DataFrame, media: DataFrame) -> DataFrame:
    """path, page_ordinal, svg. Strokes are drawn first, then elements; an image without its media
    is left out. The fragments of a page meet in one ordered aggregation by page."""
    key = ["path", "page_ordinal"]
    dark = F.coalesce("dark_mode", F.lit(False))
    heads = pages.where("error IS NULL").select(*key, "width", "height", C.color_hex(F.col("background_color")).alias("page_paper"))
    notes = documents.select("path", dark.alias("dark"), C.color_hex(F.col("background_color")).alias("note_paper"))
    heads = heads.join(notes, "path", "left").withColumn("paper", C.paper(F.col("dark"), F.col("note_paper"), F.col("page_paper")))

    inked = strokes.join(notes.select("path", "dark"), "path", "left").withColumn("ink", C.ink(F.col("dark"), C.color_hex(F.col("color"))))

    def lines(path, ordinal, nth, points, pressures, ink, width) -> Iterator[tuple]:
        yield path, ordinal, 0, nth, stroke_svg(points, pressures, ink, width)

    fragment = "path string, page_ordinal int, z int, nth int, svg string"
    drawn = _decode(inked.select(*key, "stroke_ordinal", "points", "pressures", "ink", "pen_width"), fragment, lines, 200)

    placed = elements.join(media.select("path", "media_index", "mime_type", "data"), ["path", "media_index"], "left")
    placed = placed.where("kind = 'text' OR data IS NOT NULL").join(heads.select(*key, "width", "height"), key)

    def things(path, ordinal, nth, kind, box, mime, data, text, width, height) -> Iterator[tuple]:
        yield path, ordinal, 1, nth, image_svg(box, mime, data) if kind == "image" else text_svg(text, width, height)

    put = _decode(placed.select(*key, "element_ordinal", "kind", "bbox", "mime_type", "data", "text_box", "width", "height"), fragment, things, 50)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "nth", "svg"))), lambda x: x["svg"]), "")
    bodies = drawn.unionByName(put).groupBy(*key).agg(body.alias("body"))

    def close(path, ordinal, width, height, paper, body) -> Iterator[tuple]:
        yield path, ordinal, svg_open(width, height, paper) + (body or "") + "</svg>\n"

    return _decode(heads.join(bodies, key, "left").select(*key, "width", "height", "paper", "body"), "path string, page_ordinal int, svg string", close, 20)
