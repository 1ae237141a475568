"""Shared plumbing of the corpus operators: input tables, scratch tables, row clean-up.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, the folder that a cluster
shares. They cut lineage: a lost executor costs the running stage, not the whole history.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, for Java's and DuckDB's regular expressions.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions without a setting, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="vellum-")
        where = _LOCAL[app]
    return where.rstrip("/")


class Scratch:
    """Tables of one operator run in the shared folder. The JVM deletes them when it ends;
    ``drop`` deletes one earlier."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/vellum/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write df, and return the written table: fresh lineage, known size. by: columns that
        become folders, so that a filter on them reads no others."""
        self._n += 1
        path = self.path(f"{name}-{self._n}")
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def tidy(self) -> None:
        """Let the driver's JVM collect garbage: Spark deletes the shuffle files and broadcasts of
        queries that nothing refers to any more only then, and a driver with free heap may not
        come to that for long."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = t._scratch_path
            self._fs(path).delete(self._path(path), True)


#: Rows of some 60 bytes that may be broadcast, after they are counted; more meet in a shuffle.
SMALL = 250_000
#: Rows of one key that may meet in one task of a shuffled join, or a hundred-thousandth of all, if that is more.
HOT = 1000


def listed(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """rows as the side of a join that is broadcast if they are few, and else sorted and merged."""
    return F.broadcast(rows) if rows.count() <= small else rows.hint("merge")


def join_facts(rows: DataFrame, facts: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows (`total` of them) joined with facts, one for each key; column n: how many rows have it.

    Keys with more than a hundred-thousandth of the rows are broadcast: there are fewer than
    100,000 of them at any size of the tables. So no key that is shuffled is a large one.
    """
    most = max(HOT, total // 100_000)
    hot = facts.where(F.col(n) > most)
    if hot.isEmpty():
        return rows.join(facts.hint("merge"), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(n) <= most).hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


Stage = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Stage) -> Stage:
    """run, whose worker gives its free memory back when a task ends: workers outlive tasks and
    stages, and share what the heap leaves of an executor's memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


#: What a worker remembers over tasks.
_REMEMBERED: dict[str, dict] = {}


def remembered(name: str, make: Callable[[], dict]) -> dict:
    """The named memory of this worker; that of another stage is forgotten."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def forget() -> None:
    """Forget what this worker remembers, before a task that needs the memory itself."""
    _REMEMBERED.clear()


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame):
    """Of all columns: an order among rows of one id and text that doesn't depend on their places."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        parts += [c.isNull(), F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c]
    return F.xxhash64(*parts)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
