"""Nearest neighbours by inner product over shifted Hilbert curves.

Vectors are projected at random, shifted, and put in the order of a Hilbert curve, several times.
Near vectors are often near on some curve: for each query the windows around its places, over all
curves, give candidates, which are scored exactly. In high dimensions that alone may miss much
(isotropic vectors have no near neighbours that a curve could keep together). So the windows' 20th
score is then a bound: blocks of consecutive vectors on the first curve, each in a ball around its
mean, are scanned by the query blocks for which their ball may hold anything better. On clustered
data few blocks are left; on isotropic data all are, and the result is exact in either case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table


@dataclass(frozen=True)
class Settings:
    curves: int = 4
    dims: int = 6
    bits: int = 8
    window: int = 48  # vectors to either side
    block: int = 4096
    query_block: int = 1024
    seed: int = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """cells: (n, dims) integers below 2 ** bits, dims * bits at most 62. Places on the curve, by
    the transposition of axes that undoes the curve's reflections and exchanges bit by bit."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    keys = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            keys = (keys << 1) | ((x[i] >> b) & 1)
    return keys


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.empty(0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column
    return np.asarray(flat).reshape(len(column), -1).astype(np.float64)


def valid_vectors(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, v: null ids and vectors, zero vectors, and vectors with null or non-finite components
    take no part. Vectors may differ in length: what a shorter one lacks counts as zero."""
    v = F.col(vector)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = rows.where(F.col(id_).isNotNull() & v.isNotNull()).where(fine & F.exists(v, lambda x: x != 0))
    return some.select(F.col(id_).cast("long").alias("id"), v.cast("array<double>").alias("v"))


class HilbertSearch:
    """Search among rows (id, v) for the queries: those rows whose id `every` divides."""

    def __init__(self, vectors: DataFrame, every: int, k: int, scratch: Scratch, settings: Settings = Settings()):
        self.every, self.k, self.scratch, self.settings = every, k, scratch, settings
        self.vectors = scratch.put(vectors, "vectors")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        self.longest, width, least = self.vectors.agg(F.max(norm), F.max(F.size("v")), F.min(F.size("v"))).first()
        self.width = width or 0
        if least != width:
            self.vectors = self.vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), self.width - F.size("v"))))

    def _placed(self) -> DataFrame:
        """curve, key, id, v: each vector's place on each curve. Vectors of different lengths get
        one more coordinate that makes them equally long, so that near places mean large products."""
        s, longest, width = self.settings, self.longest, self.width
        rng = np.random.default_rng(s.seed)
        turns = rng.normal(size=(s.curves, width + 1, s.dims))
        shifts = rng.uniform(-0.5, 0.5, size=(s.curves, s.dims))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch["v"]) / longest
                x = np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]])
                for c in range(s.curves):
                    # a projection of a unit vector has a spread of 1; the cells reach to 4 and a half
                    cells = ((x @ turns[c] + shifts[c] + 4.5) / 9 * (1 << s.bits)).clip(0, (1 << s.bits) - 1)
                    key = hilbert_keys(cells.astype(np.int64), s.bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), batch["id"], batch["v"]], names=["curve", "key", "id", "v"])

        return self.vectors.mapInArrow(place, "curve int, key long, id long, v array<double>")

    def bounds(self, placed: DataFrame) -> DataFrame:
        """query, bound: the k-th best score among the windows around a query's places."""
        s, every, k = self.settings, self.every, self.k

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, done = None, 0  # rows, and how many of them were asked already
            for batch in chain(batches, [None]):
                if batch is not None:
                    new = np.asarray(batch["id"]), np.asarray(batch["curve"]), _matrix(batch["v"])
                    held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
                if held is None:
                    return
                ids, curves, x = held
                # a query waits until the window after it is there
                until = len(ids) if batch is None else max(done, len(ids) - s.window)
                queries = done + np.nonzero(ids[done:until] % every == 0)[0]
                for at in range(0, len(queries), 256):
                    q = queries[at : at + 256]
                    near = q[:, None] + np.arange(-s.window, s.window + 1)[None, :]
                    fine = (near >= 0) & (near < len(ids))
                    near = near.clip(0, len(ids) - 1)
                    fine &= (curves[near] == curves[q][:, None]) & (ids[near] != ids[q][:, None])
                    score = np.einsum("qd,qwd->qw", x[q], x[near])
                    rows, places = np.nonzero(fine)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q][rows]), pa.array(ids[near[rows, places]]), pa.array(score[rows, places])], names=["query", "id", "score"])
                gone = max(0, until - s.window)
                held, done = tuple(a[gone:] for a in held), until - gone

        ordered = placed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
        found = ordered.mapInArrow(windows, "query long, id long, score double").groupBy("query", "id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return top.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") == k).select("query", "bound")

    def _blocks(self, ordered: DataFrame, most: int, bounds: bool) -> DataFrame:
        """Consecutive rows as matrices of bounded size, each with its mean and radius. Of equal
        vectors in a block only the k + 1 smallest ids can be in a result."""
        k, names = self.k, ["block", "ids", "matrix", "centre", "radius"] + (["bounds", "least"] if bounds else [])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for at in range(0, batch.num_rows, most):
                    rows = batch.slice(at, most)
                    ids, x = np.asarray(rows["id"]), _matrix(rows["v"])
                    keep = np.argsort(ids, kind="stable")
                    if not bounds:
                        _, same = np.unique(x[keep], axis=0, return_inverse=True)
                        by = np.argsort(same.ravel(), kind="stable")
                        group = same.ravel()[by]
                        nth = np.arange(len(group)) - np.searchsorted(group, group)
                        keep = keep[np.sort(by[nth <= k])]
                    ids, x = ids[keep], x[keep]
                    centre = x.mean(axis=0)
                    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
                    out = [[number], [ids.tobytes()], [x.tobytes()], [centre], [radius]]
                    if bounds:
                        b = np.nan_to_num(np.asarray(rows["bound"].to_numpy(zero_copy_only=False), dtype=float), nan=-np.inf)[keep]
                        out += [[b.tobytes()], [float(b.min())]]
                    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names)
                    number += 1

        ddl = "block long, ids binary, matrix binary, centre array<double>, radius double" + (", bounds binary, least double" if bounds else "")
        return self.scratch.put(ordered.mapInArrow(pack, ddl), "blocks")

    def run(self) -> DataFrame:
        """query_id, rank, vec_id, score: each query's k nearest, ties to the smaller id."""
        s, every, k, width = self.settings, self.every, self.k, self.width
        if not width:
            return self.vectors.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
        placed = self.scratch.put(self._placed(), "placed")
        bounds = self.scratch.put(self.bounds(placed), "bounds")
        curve = placed.where("curve = 0").select("key", "id", "v")
        data = self._blocks(curve.repartitionByRange("key", "id").sortWithinPartitions("key", "id"), s.block, False)
        queries = curve.where(F.col("id") % every == 0).join(bounds, F.col("id") == F.col("query"), "left").drop("query")
        queries = self._blocks(queries.repartitionByRange("key", "id").sortWithinPartitions("key", "id"), s.query_block, True)

        # which blocks may hold something for which queries: blocks against blocks, not rows
        size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x))
        a = queries.select(F.col("block").alias("q"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), "least")
        b = data.select(F.col("block").alias("d"), F.col("centre").alias("dc"), F.col("radius").alias("dr"))
        most = F.aggregate(F.zip_with("qc", "dc", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x) + size("qc") * F.col("dr") + size("dc") * F.col("qr") + F.col("qr") * F.col("dr")
        pairs = self.scratch.put(a.crossJoin(b).where(most >= F.col("least") - 1e-9).select("q", "d"), "pairs")
        met = pairs.join(queries.select(F.col("block").alias("q"), F.col("ids").alias("qids"), F.col("matrix").alias("qm"), "bounds"), "q")
        met = met.join(data.select(F.col("block").alias("d"), "ids", "matrix"), "d").select("qids", "qm", "bounds", "ids", "matrix")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for qids, qm, bound, ids, matrix in zip(*(c for c in batch.columns)):
                    qids, ids = np.frombuffer(qids.as_buffer(), np.int64), np.frombuffer(ids.as_buffer(), np.int64)
                    qm, x = (np.frombuffer(m.as_buffer(), np.float64).reshape(-1, width) for m in (qm, matrix))
                    bound = np.frombuffer(bound.as_buffer(), np.float64)
                    out = []
                    for at in range(0, len(qids), 256):
                        g = qm[at : at + 256] @ x.T
                        g[qids[at : at + 256, None] == ids[None, :]] = -np.inf
                        floor = bound[at : at + 256]
                        if g.shape[1] > k:
                            floor = np.maximum(floor, np.partition(g, -k, axis=1)[:, -k])
                        for i in range(len(g)):
                            # products of one matrix may differ in their last bits from a plain sum
                            slack = 1e-9 * (1 + abs(floor[i])) if np.isfinite(floor[i]) else 0.0
                            some = np.nonzero((g[i] >= floor[i] - slack) & np.isfinite(g[i]))[0]
                            score = dots(qm[at + i][None, :], x[some]) if len(some) else np.empty(0)
                            top = np.lexsort((ids[some], -score))[:k]
                            out.append((np.full(len(top), qids[at + i]), ids[some][top], score[top]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])

        found = met.mapInArrow(scan, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HilbertSearch(valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 20, 20, Scratch(spark, "op9")).run()


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    list_reduce(list_transform(range(1, least(len(q.e), len(d.e)) + 1), lambda i: q.e[i] * d.e[i]), lambda a, x: a + x) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
