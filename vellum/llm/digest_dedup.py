"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, WS, Scratch, join_facts, listed, own_names, row_hash, table, text_or_empty


def text_digest(column: str = "text"):
    """Hex SHA-256 of the text with each ASCII white-space run as one space; null is empty."""
    return F.sha2(F.regexp_replace(text_or_empty(column), WS, " "), 256)


class DigestIndex:
    """One entry per distinct text ever seen: digest, keep_id, keep_row, group_size.

    The index is a table of `buckets` buckets over the digest, each sorted by it, kept under
    `path`. A new batch meets it in a sort-merge anti-join in which the index is neither
    shuffled nor rewritten; what is new is appended, bucket by bucket. Opening the same path in
    a later session finds the same entries. `keep_row` is the batch's own row number, and tells
    apart repeated rows with the same id.
    """

    COLUMNS = "digest STRING, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "vellum_digest_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the table out of the session's catalog. The files stay, and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, found: DataFrame, batch: str) -> None:
        """Index what the index lacks of found (digest, k: doc_id and row, group_size)."""
        fresh = found.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size", F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def _groups(rows: DataFrame) -> DataFrame:
    """digest, k, group_size. Of equal texts the smallest doc_id stays, a null id last, then the
    smallest row. Added up within each task first, so a hot digest is a few rows."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return rows.groupBy("digest").agg(F.min(order).alias("k"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, scratch: Scratch, index: DigestIndex | None = None, batch: str = "batch") -> DataFrame:
    """Every row of `docs` (doc_id, text) with its group.

    Returns doc_id, row, keep_id, group_size, kept, text_sha256. Nulls and empty texts are one
    group. Of repeated rows with one id and text, one is kept. A text that an earlier batch put
    into the index keeps none of its rows here. An empty table gives no rows; other columns of
    `docs` are not looked at.
    """
    rows = scratch.put(docs.select("doc_id", text_digest().alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    got = join_facts(rows, _indexed(rows, scratch, index, batch), "digest", rows.count())
    kept = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
    return got.select("doc_id", "row", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def _indexed(rows: DataFrame, scratch: Scratch, index: DigestIndex | None, batch: str) -> DataFrame:
    """Append rows (doc_id, row, digest) to the index; its entry for each digest of them, and n, the
    number of rows that have it."""
    own = index or DigestIndex(rows.sparkSession, scratch.path("index"))
    found = scratch.put(_groups(rows), "found")
    own.append(found, batch)
    facts = scratch.put(own.entries().join(found.select("digest", F.col("group_size").alias("n")).hint("merge"), "digest"), "facts")
    if index is None:
        own.close()
    return facts


def dedup_documents(docs: DataFrame, scratch: Scratch, index: DigestIndex | None = None, batch: str = "batch") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts that with the smallest
    doc_id, a null id last, then that with the smallest hash of its row. A text that an earlier
    batch put into the index keeps none.

    While there are no more than SMALL texts of which a row goes, only digests are shuffled.
    """
    key, who, n, k = own_names(docs, "digest", "who", "n", "k")
    keyed = docs.withColumn(key, text_digest()).withColumn(who, row_hash(docs))
    rows = scratch.put(keyed.select("doc_id", F.col(key).alias("digest"), F.col(who).alias("row")), "digests")
    facts = _indexed(rows, scratch, index, batch).where((F.col("n") > 1) | (F.col("batch") != batch))
    facts = scratch.put(facts.select("digest", "n", "keep_id", "keep_row", (F.col("batch") == batch).alias("new")), "losing")
    first = lambda row, id_, k: F.col(f"{k}new") & (F.col(row) == F.col(f"{k}keep_row")) & F.col(id_).eqNullSafe(F.col(f"{k}keep_id"))
    total = rows.count()
    again = join_facts(rows, facts, "digest", total).where(first("row", "doc_id", "")).groupBy("digest").count().where("count > 1")
    again = scratch.put(again.select(F.col("digest").alias(key)), "again")  # all rows of the group's first one are equal
    losing = facts.select(F.col("digest").alias(key), F.col("n").alias(n), F.struct("keep_id", "keep_row", "new").alias(k))
    if losing.count() <= SMALL:
        met = keyed.join(F.broadcast(losing), key, "left")
    else:
        alone = keyed.join(losing.select(key).hint("merge"), key, "left_anti").withColumns({n: F.lit(1).cast("long"), k: F.lit(None).cast(losing.schema[k].dataType)})
        met = join_facts(keyed, losing, key, total, n).unionByName(alone)
    met = met.where(F.col(k).isNull() | first(who, "doc_id", f"{k}."))
    if again.isEmpty():
        return met.select(docs.columns)
    again = listed(again)
    once = met.join(again, key, "left_semi").dropDuplicates([key])
    return met.join(again, key, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def op4_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
  text_sha256
FROM d
"""
