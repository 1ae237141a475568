"""Exact and near duplicates, and components, against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.llm import common, digest_dedup, near_dedup
from vellum.llm.common import Scratch
from vellum.llm.components import connected_components
from vellum.llm.digest_dedup import DigestIndex, dedup_documents, exact_dedup
from vellum.llm.near_dedup import NearDuplicates, near_dedup_documents, shingle_set

SCHEMA = "doc_id long, text string, batch string, keep_id long"
ROWS = [(3, "a  b", "x", 1), (1, "a\tb", "x", 1), (None, "a b", None, None), (2, None, "y", 2), (5, "", "y", 2), (7, "z", "z", 3), (7, "z", "z", 3), (None, None, None, None), (9, "a b", "q", 0)]


def test_exact(spark):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA), Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in got) == sorted(
        [("3", 1, 3, False), ("1", 1, 3, True), ("None", 1, 3, False), ("2", 2, 3, True), ("5", 2, 3, False), ("None", 2, 3, False), ("7", 7, 2, True), ("7", 7, 2, False), ("9", 9, 1, True)]
    )
    kept = dedup_documents(spark.createDataFrame(ROWS, SCHEMA), Scratch(spark, "t"))
    assert kept.columns == ["doc_id", "text", "batch", "keep_id"] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 9]
    assert exact_dedup(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_index_persists(spark):
    scratch = Scratch(spark, "t")
    index = DigestIndex(spark, scratch.path("index"), 4)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup(docs((5, "a"), (6, "b")), scratch, index, "one").where("kept").count() == 2
    again = exact_dedup(docs((1, "a"), (2, "c")), scratch, DigestIndex(spark, scratch.path("index"), 4), "two").collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again) == [(1, 5, False), (2, 2, True)]
    assert index.entries().count() == 3
    fresh = docs((1, "q")).selectExpr("doc_id", "0L AS row", "text AS digest")
    plan = fresh.join(spark.table(index.name).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the index isn't shuffled


def test_documents_by_every_way(spark, monkeypatch):
    """Hot digests, many groups, an index of earlier batches, clashing names, and repeated rows."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["hot", "hot", "a  b", "a\tb", None, "", *(f"t{i}" for i in range(30))]), f"s{rng.randrange(3)}", i % 2, 7) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, n long, Who int")
    text = lambda t: " ".join((t or "").split()) if t else ""
    best = {}
    for r in rows:
        best.setdefault(text(r[1]), []).append((r[0] is None, r[0] or 0))
    results = []
    for small, hot in ((250_000, 1000), (0, 1000), (0, 5)):
        monkeypatch.setattr(digest_dedup, "SMALL", small)
        monkeypatch.setattr(common, "HOT", hot)
        for parts in (2, 5):
            got = dedup_documents(df.repartition(parts), Scratch(spark, "t"))
            assert got.columns == df.columns
            results.append(sorted(map(str, got.collect())))
        told = exact_dedup(df, Scratch(spark, "t")).collect()
        assert len(told) == 300 and sum(r.kept for r in told) == len(best) and all(r.group_size == len(best[t]) for t in best for r in told if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest())
    assert all(r == results[0] for r in results) and len(results[0]) == len(best)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(min(b) for b in best.values())
    scratch = Scratch(spark, "t")
    index = DigestIndex(spark, scratch.path("index"), 4)
    assert dedup_documents(df.where("n = 0"), scratch, index, "one").count() + dedup_documents(df.where("n = 1"), scratch, index, "two").count() == len(best)
    index.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name == index.name]


def test_long_texts(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(2, long), (1, long.replace(" ", "\n ")), (3, "x" * 2_000_000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup_documents(df, Scratch(spark, "t")).select("doc_id").collect()) == [1, 3]
    assert sorted(r.doc_id for r in near_dedup_documents(df, Scratch(spark, "t")).select("doc_id").collect()) == [1, 3]


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 200)], [(199, i) for i in range(100)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == components(200, edges) and len(got) == len({r.node for r in got})


def test_random_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == components(150, edges)


def brute(docs, k, num, den):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    edges = []
    where = {}
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where.get(x, ())).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                edges.append((j, i))
        for x in s:
            where.setdefault(x, []).append(i)
    return sets, components(len(docs), edges)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed):
    """Groups of close copies, of copies about the threshold, chains, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    texts = []
    for share in (0.004, 0.03, 0.05):
        base = [word() for _ in range(120)]
        texts += [" ".join(edited(rng, base, share)) for _ in range(60)]
    chain = [word() for _ in range(150)]
    for _ in range(25):
        chain[rng.randrange(150)] = word()
        texts.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(rng.randrange(20, 60))] + passage) for _ in range(50)]
    texts += ["", None, "One two", "one TWO", "one", "  ", "One\x0btwo", "x y z", "x y z", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k, num, den, hot", [(3, 85, 100, 1000), (5, 4, 5, 2)])
def test_near_duplicates(spark, monkeypatch, k, num, den, hot):
    monkeypatch.setattr(near_dedup, "MEMBERS", 32)
    monkeypatch.setattr(common, "HOT", hot)
    docs = corpus(k)
    sets, linked = brute(docs, k, num, den)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in NearDuplicates(df, Scratch(spark, "t"), k, num, den, block=8).run().rows().collect()}
    assert len(got) == len(docs)
    assert all(got[i].n == len(sets[i]) for i in got)
    assert {i: got[i].component_id for i in got} == {i: linked.get(i, i) for i in got}


def test_near_edge_cases(spark):
    df = spark.createDataFrame([(None, "p q r s t u"), (4, "p q r s t u"), (4, "p q r s t u"), (8, None), (9, ""), (None, "w"), (None, None)], "doc_id long, text string")
    got = NearDuplicates(df, Scratch(spark, "t"), 3, 85, 100).run().rows().collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n) for r in got) == sorted([("None", "4", 4), ("4", "4", 4), ("4", "4", 4), ("8", "8", 0), ("9", "9", 0), ("None", "None", 1), ("None", "None", 0)])
    extra = df.selectExpr("*", "1 AS root", "'x' AS text_key", "2 AS component_id", "3 AS id", "4 AS Nth")
    kept = near_dedup_documents(extra, Scratch(spark, "t"))
    assert kept.columns == extra.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "8", "9", "None", "None"]
    assert near_dedup_documents(extra.limit(0), Scratch(spark, "t")).count() == 0


def test_long_text():
    assert len(shingle_set("a b c " * 200_000, 3)) == 3


def test_large_buckets_of_every_band(spark):
    """Six linked pairs that meet in one large bucket of the last band only."""
    rows = [(2 * p + copy, " ".join(f"w{p}x{j}" for j in range(60 + copy))) for p in range(6) for copy in (0, 1)]
    search = NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), 3, 85, 100, block=2)
    bands = F.concat(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.col("cid") * 100 + i), F.array(F.lit(-1).cast("long")))
    search.classes = search.scratch.put(search.classes.withColumn("bands", bands), "classes")
    assert {r.doc_id: r.component_id for r in search.run().rows().collect()} == {i: i // 2 * 2 for i, _ in rows}
