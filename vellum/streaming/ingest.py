"""New containers in a folder, decoded as they come. Each file is decoded on its own, so there is
no state beyond the file source's list of what it has seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators import notes
from ..sources.containers import ALL, entries_of

#: What the file source gives for each file; a stream has to be told.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_entries(spark: SparkSession, folder: str, glob: str = "*", files_at_once: int = 1000, kinds: tuple[str, ...] = (ALL,)) -> DataFrame:
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).load(folder)
    return entries_of(source, kinds)


def stream_tables(entries: DataFrame, target: str, checkpoint: str, tables: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Append each batch's decoded tables below `target`; stops when all files have been read.
    Page numbers need a whole container, and a file is never split over batches."""
    tables = tables or {"documents": notes.documents, "pages": notes.pages, "strokes": notes.strokes, "elements": notes.elements}

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, of in tables.items():
            # one folder per batch: a batch that is repeated replaces its own rows
            of(batch).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        batch.unpersist()

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ink_activity(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Pen events (ts, kind, pressure) per window and kind, with a watermark for late ones."""
    raw = C.normal_pressure(F.col("pressure"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"), F.avg(raw).alias("mean_pressure"))
