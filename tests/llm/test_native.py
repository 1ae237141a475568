"""Mixing and sharding."""

import math
import random
from collections import Counter

import pytest

from vellum.llm.common import Scratch
from vellum.llm.mixing import mix, mixed_documents, source_targets, word_count
from vellum.llm.shards import shuffle_into_shards


def filled(sizes, weights, most):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        share = left / sum(w[s] for s in order if s not in capped) if len(capped) < len(order) else 0
        over = [s for s in order if s not in capped and share * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in capped else share * w[s] for s in order}
        for s in over:
            capped.add(s)
            left -= most * sizes[s]


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 5, None: 40, "é": 7, "Z": 0}, {"x": 1, "y": 1000}, {"s0": 3, "s1": 0}])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3.0).collect()
    want = filled(sizes, (5, 2, 1), 3.0)
    assert all(math.isclose(r.target, want[r.source], abs_tol=1e-6) for r in got) and math.isclose(sum(r.target for r in got), sum(sizes.values()))


def documents(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(int(rng.lognormvariate(3, 1.5)))), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(900)]
    return rows + [(None, "a b", "s2"), (7, None, "s1"), (8, "", None), (9, "same same", "s4"), *[(10, "same same same", "s4")] * 40]


def test_mix(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS p")
    args = (df, word_count(), (5, 2, 1), 3.0, 5)
    got = mix(*args, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in df.collect()}:
        own = [r for r in got if rows and r.target is not None and (r.doc_id, r.size) and r.source_size >= 0 and r["source_size"] == sum(len((t or "").split()) for _, t, s in rows if s == source)]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)  # one document is left open
        assert all(r.copies % 1 == 0 and r.taken == r.copies * r.size for r in own)
    assert all(r.taken <= 3 * r.size for r in got)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(mix(df.repartition(3), *args[1:], Scratch(spark, "t")).collect()) == key(got)
    assert mix(df.limit(0), *args[1:], Scratch(spark, "t")).count() == 0


def test_mixed_documents(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string").selectExpr("*", "doc_id % 3 AS nth", "'x' AS _copy2", "1 AS Hash", "2 AS its", "3 AS id", "4 AS copy")
    plan = mix(df, word_count(), (5, 2, 1), 3.0, 5, Scratch(spark, "t")).collect()
    got = mixed_documents(df, (5, 2, 1), 3.0, 5, Scratch(spark, "t"))
    assert got.columns == df.columns
    want = Counter()
    for r in plan:
        want[r.doc_id, r.size] += int(r.copies)
    assert all(r.copies == int(r.copies) for r in plan)
    assert Counter((r.doc_id, len((r.text or "").split())) for r in got.collect()) == +want


def test_which_repeated_rows_are_taken(spark):
    """Rows with one id, source and text that differ elsewhere: the same ones however they lie."""
    rows = [(1, "a b c", "s", i) for i in range(20)] + [(2, "x " * 50, "t", 0), (3, "y " * 300_000, "u", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    first, second = (sorted(map(hash, mixed_documents(df.repartition(n), (5, 2, 1), 3.0, 5, Scratch(spark, "t")).collect())) for n in (1, 6))
    assert first == second and len(first) > 20


def test_rounding_is_fair(spark):
    rows = [(i, "x " * (1 + i % 7), "a" if i % 4 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    times = [{r.doc_id: r.copies for r in mix(df, word_count(), (5, 2), 3.0, seed, Scratch(spark, "t")).collect()} for seed in range(12)]
    ratio = {r.doc_id: r.target / r.source_size for r in mix(df, word_count(), (5, 2), 3.0, 0, Scratch(spark, "t")).collect()}
    mean = {i: sum(t[i] for t in times) / len(times) for i in ratio}
    assert abs(sum(mean.values()) / 60 - sum(ratio.values()) / 60) < 0.1
    assert all(abs(t[i] - ratio[i]) < 1 + 1e-9 for t in times for i in ratio)


@pytest.mark.parametrize("n, shards", [(0, 3), (1, 3), (2, 40), (997, 40), (5000, 7)])
def test_shards(spark, n, shards):
    df = spark.range(n).selectExpr("id", "id AS order", "'x' AS count", "1 AS part", "2 AS row", "3 AS piece", "4 AS start", "5 AS nth", "6 AS rank", "7 AS to_shard", "8 AS held", "null AS none", "array('a.b') AS `a.b`").repartition(5)
    assert shuffle_into_shards(df, shards, 3, Scratch(spark, "t")).columns == [*df.columns, "shard", "slot"]
    got = shuffle_into_shards(df, shards, 3, Scratch(spark, "t")).collect()
    assert sorted(r.id for r in got) == list(range(n))
    sizes = Counter(r.shard for r in got)
    assert all(0 <= s < shards for s in sizes) and max(sizes.values(), default=0) - min([sizes.get(s, 0) for s in range(shards)]) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_refuse_their_own_names(spark):
    with pytest.raises(ValueError, match="slot"):
        shuffle_into_shards(spark.range(3).selectExpr("id", "id AS Slot"), 2, 3, Scratch(spark, "t"))


def test_long_rows(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, None), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.text or "")) for r in shuffle_into_shards(df, 2, 1, Scratch(spark, "t")).collect()) == [(1, 3_000_000), (2, 0), (2, 0)]


def test_shard_counts_are_hypergeometric(spark):
    """One partition's count for one shard, over many seeds: mean and variance of the exact law."""
    from vellum.llm.shards import communication_matrix

    counts = spark.createDataFrame([([30, 50, 0, 40],)], "n array<bigint>")
    seen = []
    for seed in range(150):
        rows = communication_matrix(counts, "array(48L, 60L, 12L)", seed, 2).collect()
        m = {r.part: r.to_shard for r in rows}
        assert [sum(m[p]) for p in range(4)] == [30, 50, 0, 40] and [sum(m[p][s] for p in m) for s in range(3)] == [48, 60, 12]
        seen.append(m[0][0])
    mean, var = sum(seen) / len(seen), 30 * 0.4 * 0.6 * 90 / 119
    assert abs(mean - 12) < 4 * (var / len(seen)) ** 0.5
    assert 0.6 * var < sum((x - mean) ** 2 for x in seen) / len(seen) < 1.5 * var
