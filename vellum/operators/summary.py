"""Per-page and per-file summaries of strokes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def page_summary(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per page, also for pages without strokes. An absent colour counts as one colour.
    facts: the light stroke table (n_points, n_pressures, color)."""
    hexed = F.coalesce(C.color_hex(F.col("color")), F.lit("(default)"))
    per = facts.groupBy("path", "page_ordinal").agg(
        F.count("*").alias("strokes"), F.sum("n_points").alias("points"), F.count_distinct(hexed).alias("colors"), F.count_if(F.col("n_pressures") > 0).alias("with_pressure")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.where("error IS NULL").join(per, ["path", "page_ordinal"], "left").select(
        "path", "page_ordinal", "width", "height", F.coalesce(C.color_hex(F.col("background_color")), F.lit("none")).alias("background"), F.coalesce(C.template_label(F.col("template")), F.lit("none")).alias("template"),
        "declared_strokes", zero("strokes"), zero("points"), zero("colors"), zero("with_pressure"),
    )


def report(documents: DataFrame, summary: DataFrame) -> DataFrame:
    """The text report of each container: path, lines in order as one string."""
    page = F.format_string(
        "  Page %d: %d x %d, background %s, template %s, %d strokes, %d points, %d colors, %d with pressure", "page_ordinal", "width", "height", "background", "template", "strokes", "points", "colors", "with_pressure"
    )
    lines = summary.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_ordinal", page.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.array(
        F.when(F.col("page_width").isNotNull(), F.format_string("Page dimensions: %d x %d", "page_width", "page_height")),
        F.concat(F.lit("Document background: "), C.color_hex(F.col("background_color"))),
        F.concat(F.lit("Dark mode compatibility: "), F.col("dark_mode").cast("string")),
        F.concat(F.col("n_pages").cast("string"), F.lit(" page(s)")),
    )
    return documents.join(lines, "path", "left").select("path", F.array_join(F.concat(F.array_compact(head), F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("report"), "error")


def color_distribution(strokes: DataFrame) -> DataFrame:
    hexed = F.coalesce(C.color_hex(F.col("color")), F.lit("(default)")).alias("color_hex")
    return strokes.groupBy("path", hexed).agg(F.count("*").alias("strokes")).orderBy("path", F.desc("strokes"), "color_hex")


def width_range(strokes: DataFrame) -> DataFrame:
    """Least and greatest pen width, and the distinct ones to two decimals."""
    shown = F.array_sort(F.collect_set(F.round(F.col("pen_width").cast("double"), 2)))
    return strokes.groupBy("path").agg(F.min("pen_width").alias("least"), F.max("pen_width").alias("greatest"), shown.alias("widths"))


def coverage(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Declared against decoded strokes, and how many have a colour and pressure, per file."""
    told = pages.groupBy("path").agg(F.sum("declared_strokes").alias("declared"))
    got = facts.groupBy("path").agg(
        F.count("*").alias("decoded"), F.sum("n_points").alias("points"), F.count_if(F.col("color").isNotNull()).alias("with_color"), F.count_if(F.col("n_pressures") > 0).alias("with_pressure")
    )
    return told.join(got, "path", "left").na.fill(0)


def channel_ranges(strokes: DataFrame) -> DataFrame:
    """Least and greatest value of each channel of each stroke; null for an empty channel."""
    names = ("pressures", "timestamps", "tilt_x", "tilt_y")
    return strokes.select("path", "page_ordinal", "stroke_ordinal", *[f(F.col(c)).alias(f"{c}_{k}") for c in names for k, f in (("min", F.array_min), ("max", F.array_max))])
