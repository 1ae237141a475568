"""Note containers as a table of entries.

A container is a ZIP archive (stored or deflated). Reading one is a narrow, per-file step; the
entries that a query needs are chosen before anything is inflated.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRIES = "path string, entry_ordinal int, name string, size long, compressed_size long, page_ordinal int, media_index int, data binary, error string"

#: Which entries to inflate.
PAGES, MEDIA, META, ALL = "pages", "media", "meta", "all"
_META = ("end_tag.bin", "note.note", "pageIdInfo.dat", "mediaInfo.dat")
_IMAGES = (".jpg", ".jpeg", ".png", ".webp")


def is_media(name: str) -> bool:
    return name.startswith("media/") and name.lower().endswith(_IMAGES)


def media_number(name: str) -> int | None:
    """The number before @ in the file's name, of at most 64 bits."""
    found = re.match(r"\+?([0-9]+)@", name.rsplit("/", 1)[-1])
    return int(found[1]) if found and int(found[1]) < 1 << 64 else None


def wanted(name: str, kinds: tuple[str, ...]) -> bool:
    return ALL in kinds or PAGES in kinds and name.endswith(".page") or MEDIA in kinds and is_media(name) or META in kinds and (name in _META or name.endswith("mediaInfo.dat"))


def list_entries(content: bytes | None, kinds: tuple[str, ...]) -> Iterator[tuple]:
    """Ordinal, name, sizes, page_ordinal, media_index, data and error of each entry; what isn't an
    archive is one row with an error. An entry that can't be inflated has one of its own.

    The archive's list has what the numbers need, so no entry is moved to be numbered: pages count
    in archive order, images by the numbers in their names, those without one last, then so too."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
        yield None, None, None, None, None, None, None, f"Zip: {e}"
        return
    names = [info.filename for info in archive.infolist()]
    pages = {i: n for n, i in enumerate(i for i, name in enumerate(names) if name.endswith(".page"))}
    images = [(number is None, number or 0, i) for i, name in enumerate(names) if is_media(name) for number in [media_number(name)]]
    media = {i: n for n, (_, _, i) in enumerate(sorted(images))}
    for i, info in enumerate(archive.infolist()):
        data = error = None
        if not info.is_dir() and wanted(info.filename, kinds):
            try:
                data = archive.read(info)
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, zipfile.zlib.error) as e:
                error = f"Io: {e}"
        yield i, info.filename, info.file_size, info.compress_size, pages.get(i), media.get(i), data, error


def entries_of(containers: DataFrame, kinds: tuple[str, ...] = (ALL,), path: str = "path", content: str = "content") -> DataFrame:
    """containers: any table with a path and the bytes of a container in each row."""
    schema = pa.schema([("path", pa.string()), ("entry_ordinal", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("compressed_size", pa.int64()), ("page_ordinal", pa.int32()), ("media_index", pa.int32()), ("data", pa.binary()), ("error", pa.string())])

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch["path"].to_pylist(), batch["content"]):
                rows = [(key, *e) for e in list_entries(blob.as_py(), kinds)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return containers.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(unzip, ENTRIES)


def read_containers(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """Files as rows of path and content. A filter on length or modificationTime reaches the scan,
    and the bytes are only read where a later step uses them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most_bytes) if most_bytes else files


def read_entries(spark: SparkSession, path: str, kinds: tuple[str, ...] = (ALL,), glob: str = "*") -> DataFrame:
    return entries_of(read_containers(spark, path, glob), kinds)


# SQL -------------------------------------------------------------------------------------


class NoteEntries:
    """Table function: SELECT t.*, e.* FROM t, LATERAL note_entries(t.content) e."""

    def eval(self, content: bytes):
        for row in list_entries(content, (ALL,)):
            yield row


def register_sql(spark: SparkSession) -> None:
    """Adds the table function note_entries, and the data source "notecontainer"."""
    returns = "entry_ordinal int, name string, size bigint, compressed_size bigint, page_ordinal int, media_index int, data binary, error string"
    spark.udtf.register("note_entries", F.udtf(NoteEntries, returnType=returns))
    spark.dataSource.register(NoteSource)


class NoteSource(DataSource):
    """spark.read.format("notecontainer").option("kinds", "pages,meta").load(folder): the entries
    of the containers in a folder that every executor can open by path, a file per partition.
    For other file systems use read_entries, which goes through Spark's own file scan."""

    @classmethod
    def name(cls) -> str:
        return "notecontainer"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.kinds = tuple(options.get("kinds", ALL).split(","))
        self.glob = options.get("glob", "*")

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        top = Path(self.folder)
        files = [top] if top.is_file() else sorted(p for p in top.rglob(self.glob) if p.is_file())
        return [InputPartition(str(p)) for p in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for row in list_entries(f.read(), self.kinds):
                yield partition.value, *row
