"""Neighbour search, the pipeline, and the registry."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from vellum.llm import hilbert_ann
from vellum.llm.common import Scratch
from vellum.llm.hilbert_ann import HilbertSearch, Settings, hilbert_keys, valid_vectors


def test_hilbert_curve():
    """Every cell once, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k, every):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            score = lambda v: float(np.cumsum([a * b for a, b in zip(q, v)])[-1])
            out[i] = sorted(((-score(v), j) for j, v in fine if j != i))[:k]
    return out


@pytest.mark.parametrize("kind", ["clustered", "isotropic", "copies", "few"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(7)
    n = {"few": 12}.get(kind, 700)
    x = rng.normal(size=(n, 16))
    if kind == "clustered":
        x = rng.normal(size=(10, 16))[rng.integers(0, 10, n)] * 5 + x * 0.1
    if kind == "copies":
        x[::3] = x[0]
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(n)] + [(1001, None), (1020, [0.0] * 16), (1040, [None] * 16), (1060, [float("nan")] * 16), (1080, [1.0]), (1081, [0.5, -3.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS key", "3 AS query")
    settings = Settings(block=128, query_block=16, window=8)
    got = {}
    for r in HilbertSearch(valid_vectors(df, "vec_id", "embedding"), 20, 20, Scratch(spark, "t"), settings).run().collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    want = brute(rows, 20, 20)
    assert {q: [(i + 1, s, v) for i, (s, v) in enumerate(top)] for q, top in want.items()} == {q: sorted(top) for q, top in got.items()}


def test_windows_cross_batches(spark):
    """A query sees both sides of its window, however the rows come in batches."""
    x = np.random.default_rng(5).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    found = []
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for rows in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        search = HilbertSearch(valid_vectors(df, "vec_id", "embedding"), 20, 20, Scratch(spark, "t"), Settings(window=12))
        found.append({r.query: r.bound for r in search.bounds(search._placed()).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found[0]) == 15 and found[0] == found[1]


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert HilbertSearch(valid_vectors(df, "vec_id", "embedding"), 20, 20, Scratch(spark, "t")).run().count() == 0


def test_blocks_are_pruned(spark, monkeypatch):
    """On clustered vectors many pairs of blocks are never scanned."""
    rng = np.random.default_rng(1)
    centres = np.eye(16)[rng.permutation(16)[:8]] * 9
    x = np.repeat(centres, 200, axis=0) + rng.normal(size=(1600, 16)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen, put = [], Scratch.put

    def watched(self, d, name):
        out = put(self, d, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "put", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    HilbertSearch(valid_vectors(df, "vec_id", "embedding"), 20, 20, Scratch(spark, "t"), Settings(block=50, query_block=8)).run().count()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    (data, queries), (pairs,) = ([n for name, n in seen if name == kind] for kind in ("blocks", "pairs"))
    assert pairs < 0.75 * data * queries


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    docs = []
    for i in range(300):
        docs.append([i, " ".join(word() for _ in range(rng.randrange(20, 90))), "en", f"s{i % 4}", 0])
    for i in range(300, 330):
        docs.append([i, docs[i - 300][1], "en", "s1", 0])  # copies
    for i in range(330, 345):
        docs.append([i, docs[i - 330][1] + " more", "en", "s2", 0])  # near copies
    for i in range(345, 400):
        docs.append([i, " ".join(word() + "###" for _ in range(40)), "en", "s3", 0])
    return [(*d[:4], len(d[1])) for d in docs]


def test_pipeline(spark, tmp_path):
    docs = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = [(None, None, None, None, None), (None, "", None, None, None)]
    spark.createDataFrame(docs + more, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 345), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, df, str(tmp_path))
        assert new.columns == df.columns
        path = f"{tmp_path}/{name.split()[0]}"
        new.write.parquet(path)
        df = spark.read.parquet(path)
        counts.append({r.doc_id for r in df.collect()})
    assert counts[0] - {None} == set(range(345))  # clean documents stay, junk goes
    assert counts[1] - {None} == set(range(300)) | set(range(330, 345))
    assert counts[2] - {None} == set(range(300))
    assert counts[3] <= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert packed.where("piece = 0").count() == df.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_registry():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert hilbert_ann.OP9_SQL
