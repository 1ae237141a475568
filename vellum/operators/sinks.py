"""Sinks: JSON documents, and SVG or PNG files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .notes import _decode, documents, elements, media, pages, strokes


def document_json(entries: DataFrame) -> DataFrame:
    """path, json: the whole nested document, enums tagged by their name from outside."""
    e = elements(entries)
    image = F.when(F.col("kind") == "image", F.struct("bbox", "media_index"))
    box = F.when(F.col("kind") == "text", F.col("text_box"))
    element = F.struct(image.alias("Image"), box.alias("TextBox"))
    e = e.groupBy("path", "page_ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("element_ordinal", element.alias("e")))), lambda x: x["e"]).alias("elements"))
    stroke = F.struct("stroke_ordinal", F.struct("bbox", "points", "pressures", "timestamps", "tilt_x", "tilt_y", "color", "pen_width").alias("s"))
    s = strokes(entries).groupBy("path", "page_ordinal").agg(F.transform(F.array_sort(F.collect_list(stroke)), lambda x: x["s"]).alias("strokes"))
    p = pages(entries).where("error IS NULL").join(s, ["path", "page_ordinal"], "left").join(e, ["path", "page_ordinal"], "left")
    t = F.col("template")
    own = F.when(t["source"] == "CustomPdf", F.to_json(F.struct(F.struct(t["page_index"].alias("page_index")).alias("CustomPdf"))))
    source = F.coalesce(own, F.lit('"BuiltIn"'))
    # the source of a template is either a bare name or an object, which one column type can't be
    template = F.when(t.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"id":'), t["id"].cast("string"), F.lit(',"source":'), source, F.lit("}")))
    none = {"ignoreNullFields": "false"}
    empty = lambda c: F.coalesce(F.to_json(c, none), F.lit("[]"))
    page = F.concat(
        F.lit('{"uuid":'), F.to_json(F.array("uuid"), none).substr(F.lit(2), F.length(F.to_json(F.array("uuid"), none)) - 2),
        F.lit(',"width":'), F.col("width").cast("string"), F.lit(',"height":'), F.col("height").cast("string"),
        F.lit(',"content_bbox":'), F.to_json("content_bbox", none), F.lit(',"background_color":'), F.coalesce(F.to_json("background_color", none), F.lit("null")),
        F.lit(',"template":'), template, F.lit(',"strokes":'), empty("strokes"), F.lit(',"elements":'), F.coalesce(F.to_json("elements"), F.lit("[]")), F.lit("}"),
    )
    p = p.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_ordinal", page.alias("j")))), lambda x: x["j"]), ",").alias("pages"))
    m = media(entries).select("path", F.struct("media_index", "name", "mime_type", C.base64_text(F.col("data")).alias("data")).alias("m"))
    m = m.groupBy("path").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: F.struct(x["name"].alias("name"), x["mime_type"].alias("mime_type"), x["data"].alias("data"))).alias("media_assets"))
    d = documents(entries).join(m, "path", "left").join(p, "path", "left")
    dims = F.when(F.col("page_width").isNotNull(), F.array("page_width", "page_height"))
    meta = F.struct(
        "created_ms", "modified_ms", "background_color", F.col("dark_mode").alias("dark_mode_compatibility"), dims.alias("page_dimensions"), "page_ids",
        F.coalesce("media_assets", F.array().cast("array<struct<name:string,mime_type:string,data:string>>")).alias("media_assets"), "note_text",
    )
    return d.where("error IS NULL").select("path", F.concat(F.lit('{"pages":['), F.col("pages"), F.lit('],"metadata":'), F.to_json(meta, none), F.lit("}")).alias("json"))


def output_files(rendered: DataFrame, content: str, base: DataFrame) -> DataFrame:
    """rendered: path, page_ordinal, content; base: path, output (where a file goes if it is the
    only one), extension. Returns out_path and bytes."""
    n = rendered.groupBy("path").agg(F.count("*").alias("n_pages"))
    placed = rendered.join(n, "path").join(base, "path")
    out = C.output_path(F.col("output"), F.col("page_ordinal"), F.col("n_pages"), F.col("extension"))
    return placed.select("path", "page_ordinal", out.alias("out_path"), F.col(content).cast("binary").alias("bytes"))


def write_files(files: DataFrame) -> DataFrame:
    """Write each row's bytes to its out_path, on any file system that pyarrow opens by address.
    Returns out_path and n_bytes; nothing is written before the result is used. A file appears
    under its name only when it is whole, so a task that runs twice does no harm."""

    def write(path, data) -> Iterator[tuple]:
        import uuid

        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        part = f"{place}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part, compression=None) as out:
            out.write(data)
        store.move(part, place)
        yield path, len(data)

    return _decode(files.select("out_path", "bytes"), "out_path string, n_bytes long", write)
