"""The levels of a note as tables: documents, pages, strokes, points, elements, runs, media.

Every function takes the entries table. Ordinals carry the order that the format gives by place.
A malformed page is a row with an error and no strokes or elements; `fail_on_errors` turns such
rows into an exception instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import binary as B

RGB = "struct<r:smallint,g:smallint,b:smallint>"
BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
RUNS = "array<struct<start:int,end:int,bold:boolean,italic:boolean>>"
TEXT = f"struct<bbox:{BOX},rotation_degrees:double,text:string,color:{RGB},highlight_color:{RGB},underline:boolean,font_size:float,runs:{RUNS}>"
TEMPLATE = "struct<id:bigint,source:string,page_index:bigint>"

PAGE = f"path string, page_ordinal int, name string, uuid string, width long, height long, content_bbox {BOX}, background_color {RGB}, template {TEMPLATE}, declared_strokes long, base long, error string"
STROKE_KEY = "path string, page_ordinal int, stroke_ordinal int, layout string"
STROKE = f"{STROKE_KEY}, bbox {BOX}, n_points_declared int, points array<struct<x:double,y:double>>, pressures array<double>, timestamps array<bigint>, tilt_x array<bigint>, tilt_y array<bigint>, color {RGB}, pen_width float"
STROKE_FACTS = f"{STROKE_KEY}, n_points int, n_pressures int, color {RGB}, pen_width float"
ELEMENT = f"path string, page_ordinal int, element_ordinal int, kind string, bbox {BOX}, media_index int, text_box {TEXT}"


def _rgb(c: B.Rgb | None) -> dict | None:
    return None if c is None else dict(zip("rgb", c))


def _box(b: B.Box) -> dict:
    return dict(zip(("x_min", "y_min", "x_max", "y_max"), b))


def _text(t: B.TextBox | None) -> dict | None:
    if t is None:
        return None
    runs = [dict(zip(("start", "end", "bold", "italic"), r)) for r in t.runs]
    return {
        "bbox": _box(t.box), "rotation_degrees": t.rotation, "text": t.text, "color": _rgb(t.colour), "highlight_color": _rgb(t.highlight),
        "underline": t.underline, "font_size": t.font_size, "runs": runs,
    }


def _decode(df: DataFrame, ddl: str, rows_of: Callable[..., Iterator[tuple]], at_once: int = 2000) -> DataFrame:
    """Rows from each row of df, in Arrow batches of bounded length."""
    kind = StructType.fromDDL(ddl)
    schema = to_arrow_schema(kind)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            # blobs become Python objects one at a time
            for row in zip(*((v.as_py() for v in c) if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns)):
                for r in rows_of(*row):
                    held.append(r)
                    if len(held) >= at_once:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    return df.mapInArrow(run, kind)


# pages -----------------------------------------------------------------------------------


def page_entries(entries: DataFrame) -> DataFrame:
    """path, page_ordinal, name, data, error of the page entries, numbered in archive order."""
    return entries.where("page_ordinal IS NOT NULL").select("path", "page_ordinal", "name", "data", "error")


def pages(entries: DataFrame) -> DataFrame:
    def header(path, ordinal, name, data, error) -> Iterator[tuple]:
        if data is None:
            yield path, ordinal, name, *[None] * 8, error or "Io: no data"
            return
        try:
            h = B.page_header(data)
        except B.NoteError as e:
            yield path, ordinal, name, *[None] * 8, f"Format: {e}"
            return
        template = h.template and dict(zip(("id", "source", "page_index"), h.template))
        yield path, ordinal, name, h.uuid, h.width, h.height, _box(h.content_box), _rgb(h.background), template, h.declared, h.base, None

    return _decode(page_entries(entries), PAGE, header)


def _frames(data: bytes | None) -> tuple[B.PageHeader, list[B.StrokeFrame], int] | None:
    try:
        header = B.page_header(data) if data is not None else None
    except B.NoteError:
        return None
    return header and (header, *B.stroke_frames(data, header))


def strokes(entries: DataFrame) -> DataFrame:
    """One row per stroke, with its points and channels as arrays; the channels have a value for
    each step, so value k belongs to point k + 1."""

    def rows(path, ordinal, name, data, error) -> Iterator[tuple]:
        for i, f in enumerate((_frames(data) or (None, [], 0))[1]):
            blob = data[f.data_at : f.data_at + f.data_bytes]
            xy = B.coordinates(blob, f.start, f.deltas)
            pressure, time, tilt_x, tilt_y = B.channels(blob, 4 * f.deltas, f.deltas)
            colour, width = B.pen(blob)
            points = [{"x": x, "y": y} for x, y in xy.tolist()]
            yield path, ordinal, i, f.layout, _box(f.box), f.declared_points, points, B.pressures(pressure), time, tilt_x, tilt_y, _rgb(colour), width

    return _decode(page_entries(entries), STROKE, rows, 200)


def stroke_facts(entries: DataFrame) -> DataFrame:
    """Counts, colour and width of each stroke, without decoding points or channels."""

    def rows(path, ordinal, name, data, error) -> Iterator[tuple]:
        for i, f in enumerate((_frames(data) or (None, [], 0))[1]):
            colour, width = B.pen(data[f.data_at : f.data_at + f.data_bytes])
            holds = 4 * f.deltas + 4 + 2 * f.deltas <= f.data_bytes
            yield path, ordinal, i, f.layout, f.deltas + 1, f.deltas if holds else 0, _rgb(colour), width

    return _decode(page_entries(entries), STROKE_FACTS, rows)


def points(strokes: DataFrame) -> DataFrame:
    """One row per point, with the channels of the step that led to it (none for the first)."""
    exploded = strokes.select("path", "page_ordinal", "stroke_ordinal", F.posexplode("points").alias("point_ordinal", "p"), "pressures", "timestamps", "tilt_x", "tilt_y")
    step = lambda c: F.when(F.col("point_ordinal") > 0, F.get(F.col(c), F.col("point_ordinal") - 1))
    return exploded.select("path", "page_ordinal", "stroke_ordinal", "point_ordinal", "p.x", "p.y", step("pressures").alias("pressure"), step("timestamps").alias("t"), step("tilt_x").alias("tilt_x"), step("tilt_y").alias("tilt_y"))


def elements(entries: DataFrame) -> DataFrame:
    """Images and text boxes in the order of their ids; the note's body comes last on page 0."""

    def rows(path, ordinal, name, data, error) -> Iterator[tuple]:
        if found := _frames(data):
            header, _, end = found
            for i, (kind, box, media, text) in enumerate(B.page_elements(data, end, header.width, header.height)):
                yield path, ordinal, i, kind, _box(box), media, _text(text)

    placed = _decode(page_entries(entries), ELEMENT, rows)
    body = documents_meta(entries).where("note_text IS NOT NULL").select("path", F.col("note_text").alias("text_box"))
    first = page_entries(entries).where("page_ordinal = 0").select("path")
    last = placed.where("page_ordinal = 0").groupBy("path").agg(F.count("*").alias("n"))
    body = body.join(first, "path").join(last, "path", "left").select(
        "path", F.lit(0).alias("page_ordinal"), F.coalesce("n", F.lit(0)).cast("int").alias("element_ordinal"), F.lit("text").alias("kind"), "text_box.bbox", F.lit(None).cast("int").alias("media_index"), "text_box"
    )
    return placed.unionByName(body)


def runs(elements: DataFrame) -> DataFrame:
    exploded = elements.where("kind = 'text'").select("path", "page_ordinal", "element_ordinal", F.posexplode("text_box.runs").alias("run_ordinal", "r"))
    return exploded.select("path", "page_ordinal", "element_ordinal", "run_ordinal", "r.*")


# documents and media ---------------------------------------------------------------------

META = f"created_ms long, modified_ms long, background_color {RGB}, dark_mode boolean, page_width long, page_height long, page_ids array<string>, note_text {TEXT}"


def documents_meta(entries: DataFrame) -> DataFrame:
    """Decoded metadata, one row per path; an entry that is missing leaves its fields null."""

    def rows(path, name, data) -> Iterator[tuple]:
        created = modified = background = dark = width = height = body = None
        ids: list[str] = []
        if data is not None and name == "end_tag.bin":
            created, modified = B.end_tag(data)
        elif data is not None and name == "note.note":
            h = B.note_header(data)
            background, dark, (width, height) = _rgb(h.background), h.dark_mode, h.dimensions or (None, None)
            body = _text(B.note_text(data))
        elif data is not None and name == "pageIdInfo.dat":
            ids = B.page_ids(data)
        yield path, created, modified, background, dark, width, height, ids, body

    named = entries.where(F.col("name").isin("end_tag.bin", "note.note", "pageIdInfo.dat")).select("path", "name", "data")
    each = _decode(named, "path string, " + META, rows)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("created_ms", "modified_ms", "background_color", "dark_mode", "page_width", "page_height")]
    return each.groupBy("path").agg(*first, F.max_by("page_ids", F.size("page_ids")).alias("page_ids"), F.first("note_text", ignorenulls=True).alias("note_text"))


def documents(entries: DataFrame) -> DataFrame:
    """One row per container, with its metadata, number of pages, and first error. A container
    without pages has one: the format requires a page."""
    per = entries.groupBy("path").agg(
        F.count("page_ordinal").cast("int").alias("n_pages"),
        F.count("media_index").cast("int").alias("n_media"),
        F.min("error").alias("entry_error"),
    )
    broken = pages(entries).where("error IS NOT NULL").groupBy("path").agg(F.min_by("error", "page_ordinal").alias("page_error"))
    none = F.when(F.col("n_pages") == 0, F.lit("Format: no .page files found in archive"))
    got = per.join(documents_meta(entries), "path", "left").join(broken, "path", "left")
    return got.withColumn("page_ids", F.coalesce("page_ids", F.array().cast("array<string>"))).withColumn("error", F.coalesce("entry_error", none, "page_error")).drop("entry_error", "page_error")


def mime_type(name: str | Column = "name") -> Column:
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.when(low.endswith(".png"), "image/png").when(low.endswith(".webp"), "image/webp").otherwise("image/jpeg")


def media(entries: DataFrame) -> DataFrame:
    """Images in the order of the numbers in their names, ties in archive order."""
    return entries.where("media_index IS NOT NULL").select("path", "media_index", "name", mime_type().alias("mime_type"), "data")


def preview(pages: DataFrame, strokes: DataFrame, most: int = 5) -> DataFrame:
    """The first strokes of each note's first page."""
    first = pages.where("error IS NULL").groupBy("path").agg(F.min("page_ordinal").alias("page_ordinal"))
    return strokes.where(F.col("stroke_ordinal") < most).join(first, ["path", "page_ordinal"], "left_semi")


def fail_on_errors(rows: DataFrame) -> DataFrame:
    """Raise on the first row whose error isn't null."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error"))))
    return rows.withColumn("error", F.coalesce(checked.cast("string"), F.col("error")))


# inspection ------------------------------------------------------------------------------


def listing(entries: DataFrame) -> DataFrame:
    """Sizes, ratio and purpose of every entry."""
    name = F.col("name")
    purpose = (
        F.when(name == "end_tag.bin", "footer with times").when(name == "note.note", "note metadata").when(name == "pageIdInfo.dat", "page registry")
        .when(name.endswith("mediaInfo.dat"), "media manifest").when(name.endswith(".page"), "page").when(name.startswith("media/"), "media").otherwise("other")
    )
    ratio = F.when(F.col("size") > 0, 1 - F.col("compressed_size") / F.col("size"))
    return entries.select("path", "entry_ordinal", "name", "size", "compressed_size", ratio.alias("ratio"), purpose.alias("purpose"))


def inspection(entries: DataFrame) -> DataFrame:
    """Footer text, image kind, and printable strings of every entry that was inflated."""

    def rows(path, ordinal, name, data) -> Iterator[tuple]:
        strings = lambda found: [{"offset": at, "text": s} for at, s in found]
        yield path, ordinal, name, B.footer(data), data.endswith(B.TRAILER_MARK), B.sniff(data), strings(B.ascii_strings(data)), strings(B.utf16_strings(data))

    some = entries.where("data IS NOT NULL").select("path", "entry_ordinal", "name", "data")
    strings = "array<struct<offset:int,text:string>>"
    return _decode(some, f"path string, entry_ordinal int, name string, footer string, has_trailer boolean, image_kind string, ascii {strings}, utf16 {strings}", rows, 100)


def hex_rows(entries: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    def rows(path, name, data) -> Iterator[tuple]:
        for i, text in enumerate(B.hex_dump(data, offset, limit)):
            yield path, name, i, text

    return _decode(entries.where("data IS NOT NULL").select("path", "name", "data"), "path string, name string, row int, text string", rows)


def manifest_check(entries: DataFrame) -> DataFrame:
    """The manifest's name and digest against the file that it names."""

    def rows(path, data) -> Iterator[tuple]:
        if found := B.media_manifest(data):
            yield path, *found

    told = _decode(entries.where(F.col("name").endswith("mediaInfo.dat") & F.col("data").isNotNull()).select("path", "data"), "path string, file string, sha256 string, has_trailer boolean", rows)
    files = entries.select("path", F.substring_index("name", "/", -1).alias("file"), F.sha2("data", 256).alias("actual"))
    return told.join(files, ["path", "file"], "left").withColumn("matches", F.lower("sha256").eqNullSafe(F.col("actual")))


def page_id_check(entries: DataFrame) -> DataFrame:
    """Registry ids and page entries: which of them have a counterpart."""
    ids = documents_meta(entries).select("path", F.posexplode("page_ids").alias("registry_ordinal", "uuid"))
    names = page_entries(entries).select("path", "page_ordinal", F.regexp_replace(F.substring_index("name", "/", -1), r"\.page$", "").alias("uuid"))
    return ids.join(names, ["path", "uuid"], "full").withColumn("matches", F.col("registry_ordinal").isNotNull() & F.col("page_ordinal").isNotNull())


def bbox_check(strokes: DataFrame) -> DataFrame:
    """A stroke's own box against the extent of its points."""
    extent = lambda c, f: f(F.transform("points", lambda p: p[c]))
    got = strokes.select("path", "page_ordinal", "stroke_ordinal", "bbox", extent("x", F.array_min).alias("x_min"), extent("y", F.array_min).alias("y_min"), extent("x", F.array_max).alias("x_max"), extent("y", F.array_max).alias("y_max"))
    same = lambda c: F.abs(F.col(f"bbox.{c}") - F.col(c)) < 1e-6
    return got.withColumn("matches", same("x_min") & same("y_min") & same("x_max") & same("y_max"))
