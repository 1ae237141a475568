"""Command line: python -m vellum PATH [-o OUTPUT] [-f svg|png]."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import notes, raster, render, sinks, summary
from .sources.containers import ALL, read_entries

VERSION = "0.1.0"


def resolve_format(flag: str | None, output: str | None) -> str:
    """The flag, else the output's extension, else svg."""
    extension = os.path.splitext(output)[1][1:] if output else ""
    chosen = flag or extension or "svg"
    if chosen.lower() not in ("svg", "png"):
        raise ValueError(f"unsupported output extension {extension!r}: use svg or png, or give --format")
    return chosen.lower()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("vellum", description="Summarise note containers and draw their pages.")
    parser.add_argument("path", help="a container, or a folder of containers")
    parser.add_argument("-o", "--output", help="file to write; several pages get _page{i}")
    parser.add_argument("-f", "--format", choices=("svg", "png"))
    parser.add_argument("--version", action="version", version=VERSION)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("vellum").config("spark.ui.enabled", "false").getOrCreate()
    try:
        entries = read_entries(spark, args.path, (ALL,))
        docs, pages = notes.documents(entries), notes.pages(entries)
        told = summary.report(docs, summary.page_summary(pages, notes.stroke_facts(entries)))
        failed = False
        for row in told.toLocalIterator():
            print(f"Error: {row.error}" if row.error else row.report, file=sys.stderr)
            failed |= row.error is not None
        if failed and not os.path.isdir(args.path):
            return 1
        form = resolve_format(args.format, args.output)
        good = docs.where("error IS NULL").select("path")
        svgs = render.page_svg(pages, docs, notes.strokes(entries), notes.elements(entries), notes.media(entries)).join(good, "path", "left_semi")
        drawn = raster.page_png(svgs) if form == "png" else svgs
        place = F.lit(args.output) if args.output else F.concat(F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), r"\.[^./]*$", ""), F.lit(f".{form}"))
        base = good.select("path", place.alias("output"), F.lit(form).alias("extension"))
        for row in sinks.write_files(sinks.output_files(drawn, form, base)).toLocalIterator():
            print(f"Wrote {row.out_path} ({row.n_bytes} bytes)", file=sys.stderr)
    except Exception as e:  # noqa: BLE001  what went wrong is the user's to read
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return int(failed)
