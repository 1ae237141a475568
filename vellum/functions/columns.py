"""Column builders: formatting and rendering rules as Catalyst expressions."""

from __future__ import annotations


from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Fixed values of the rendering.
INK_DARK, INK_LIGHT = "#ffffff", "#1a1a1a"
PAPER_DARK, PAPER_LIGHT = "#252525", "#fcfcfc"
TEXT_COLOUR = "#252525"
PRESSED = 0.01
DEFAULT_FONT = 37.0
LINE = 1.35


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def hex_byte(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c.cast("int")), 2, "0"))


def color_hex(c: Column) -> Column:
    """#rrggbb of a struct r, g, b; null for null."""
    return F.when(c.isNotNull(), F.concat(F.lit("#"), hex_byte(c["r"]), hex_byte(c["g"]), hex_byte(c["b"])))


def stroke_width(pen: Column) -> Column:
    raw = pen.cast("double") / 2.5
    return F.when(_finite(raw) & (raw > 0), F.least(F.greatest(raw, F.lit(0.4)), F.lit(12.0))).otherwise(1.0)


def font_size(size: Column) -> Column:
    raw = size.cast("double")
    scaled = F.least(F.greatest(raw * 2.18, F.lit(8.0)), F.lit(96.0))
    return F.when(_finite(raw) & (raw > 0), scaled).otherwise(DEFAULT_FONT)


def escape_xml(c: Column) -> Column:
    for plain, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(named))
    return c


def has_pressure(pressures: Column, n_points: Column) -> Column:
    return (F.size(pressures) >= n_points - 1) & F.exists(pressures, lambda p: p > PRESSED)


def segment_width(base: Column, pressure: Column) -> Column:
    return base * (0.3 + 0.7 * F.greatest(pressure, F.lit(0.05)))


def paper(dark: Column, document: Column, page: Column) -> Column:
    """Background of a page from two hex colours: in the dark the document's comes first."""
    dark = F.coalesce(dark, F.lit(False))
    return F.when(dark, F.coalesce(document, page, F.lit(PAPER_DARK))).otherwise(F.coalesce(page, document, F.lit(PAPER_LIGHT)))


def ink(dark: Column, colour: Column) -> Column:
    return F.coalesce(colour, F.when(F.coalesce(dark, F.lit(False)), INK_DARK).otherwise(INK_LIGHT))


def template_label(template: Column) -> Column:
    own = F.concat(F.lit("custom PDF page "), (template["page_index"] + 1).cast("string"))
    return F.when(template["source"] == "CustomPdf", own).when(template.isNotNull(), F.concat(F.lit("built-in "), template["id"].cast("string")))


def output_format(flag: Column, path: Column) -> Column:
    """svg or png: the flag, else the path's extension, else svg; null for an unknown extension."""
    name = F.substring_index(path, "/", -1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    by_path = F.when(path.isNull() | (extension == ""), "svg").when(extension.isin("svg", "png"), extension)
    return F.coalesce(F.lower(flag), by_path)


def output_path(base: Column, page: Column, pages: Column, extension: Column) -> Column:
    """The base itself for a single page; else stem_page{i}.ext in its folder."""
    name = F.substring_index(base, "/", -1)
    folder = F.substring(base, F.lit(1), F.length(base) - F.length(name))
    stem, own = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    stem = F.when(stem == "", name).otherwise(stem)
    return F.when(pages == 1, base).otherwise(F.concat(folder, stem, F.lit("_page"), page.cast("string"), F.lit("."), F.when(own == "", extension).otherwise(own)))


def base64_text(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def text_lines(text: Column) -> Column:
    """Lines of a text without its trailing line feeds; a carriage return before one goes too."""
    body = F.regexp_replace(text, "\n+$", "")
    return F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def line_starts(lines: Column) -> Column:
    """Index of each line's first character, a line feed being one."""
    before = lambda i: F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x) + 1)
    return F.transform(lines, lambda _, i: before(i))


def styled_spans(line: Column, start: Column, runs: Column) -> Column:
    """text, bold, italic of the pieces into which the runs (start, end, bold, italic) cut a line."""
    n = F.length(line)
    inside = lambda c: F.least(F.greatest(c - start, F.lit(0)), n)
    cut = F.filter(runs, lambda r: inside(r["start"]) < inside(r["end"]))
    edges = F.flatten(F.array(F.array(F.lit(0), n), F.transform(cut, lambda r: inside(r["start"])), F.transform(cut, lambda r: inside(r["end"]))))
    edges = F.array_sort(F.array_distinct(edges))
    pairs = F.zip_with(edges, F.slice(edges, F.lit(2), F.size(edges)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda p: p["b"].isNotNull())

    def over(p: Column, name: str) -> Column:
        return F.exists(runs, lambda r: r[name] & (r["start"] < start + p["b"]) & (r["end"] > start + p["a"]))

    return F.transform(pairs, lambda p: F.struct(F.substring(line, p["a"] + 1, p["b"] - p["a"]).alias("text"), over(p, "bold").alias("bold"), over(p, "italic").alias("italic")))


# decoding twins, for rows whose bytes or deltas are already columns -----------------------


def byte_at(hex_text: Column, i: Column | int) -> Column:
    """Byte i of a hex string, as an integer."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(hex_text, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")


def little_endian(hex_text: Column, at: Column | int, size: int) -> Column:
    """Unsigned integer of `size` bytes; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    total = byte_at(hex_text, at)
    for k in range(1, size):
        total = total + byte_at(hex_text, at + k) * (1 << (8 * k))
    return F.when(F.length(hex_text) >= 2 * (at + size), total)


def sign_magnitudes(hex_text: Column, count: int) -> Column:
    """Values of up to `count` pairs of magnitude and flag."""
    pairs = F.least(F.lit(count), F.floor(F.length(hex_text) / 4).cast("int"))
    value = lambda i: F.when(byte_at(hex_text, 2 * i + 1) == 0, byte_at(hex_text, 2 * i)).otherwise(-byte_at(hex_text, 2 * i))
    return F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), value)).otherwise(F.array().cast("array<bigint>"))


def running(value: Column, key: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def normal_pressure(raw: Column) -> Column:
    return F.least(F.greatest(raw / 1400.0, F.lit(0.0)), F.lit(1.0))


def plausible_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    fine = _finite(x0) & _finite(y0) & _finite(x1) & _finite(y1)
    return fine & (x0 >= 1) & (y0 >= 1) & (x1 - x0 > 8) & (y1 - y0 > 8) & (x1 <= width * 1.25) & (y1 <= height * 1.25)


def plausible_text(text: Column) -> Column:
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    common = F.length(F.regexp_replace(text, r"[^\x21-\x7e]", ""))
    return (solid >= 3) & (common * 4 >= solid * 3)


def is_uuid(text: Column) -> Column:
    return text.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def template_of(base: Column, field: Column) -> Column:
    """The template that the header's field names, by the header's family."""
    index = F.shiftrightunsigned(field, 16)
    own = F.struct(index.alias("id"), F.lit("CustomPdf").alias("source"), index.alias("page_index"))
    built = F.struct(field.alias("id"), F.lit("BuiltIn").alias("source"), F.lit(None).cast("bigint").alias("page_index"))
    return F.when(base == 0xA6, own).when((field >= 1) & (field <= 0xFFFF), built)


def rotation_degrees(dx: Column, dy: Column) -> Column:
    degrees = F.degrees(F.atan2(dy, dx))
    return F.when((F.hypot(dx, dy) > 40) & (F.abs(degrees) > 5) & (F.abs(degrees) < 85), degrees)


