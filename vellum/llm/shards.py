"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

With a uniform random shuffle, how many rows of each input partition land in each shard is
multivariate hypergeometric. That matrix is drawn exactly, top down over a binary tree of the
partitions: at each node the shard counts of the node's rows are split between its halves. Each
partition then permutes its rows and deals them out by its counts, the rows are exchanged, and
each shard permutes what it received. All of it is SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table, text_or_empty

#: A shard's rows are ranked in pieces of about so many rows.
RANKED = 1 << 17


def _uniform(*parts: str) -> str:
    """A number in (0, 1) that depends on the given SQL expressions only."""
    return f"((xxhash64({', '.join(parts)}) & 9007199254740991L) + 0.5D) / 9007199254740992D"


def _hypergeometric(total: str, good: str, sample: str, u: str) -> str:
    """SQL for a draw of how many of `good` are among `sample` out of `total`.

    Inversion from the mode outward: the weights follow from their ratios, so no factorials are
    needed. Beyond 12 standard deviations and 30 counts the weights are below a double's reach.
    """
    at = (
        f"named_struct('t', cast({total} as double), 'g', cast({good} as double), 'n', cast({sample} as double), 'u', {u},"
        f" 'lo', greatest(0L, {sample} - ({total} - {good})), 'hi', least({sample}, {good}))"
    )
    mode = "least(a.hi, greatest(a.lo, cast(floor((a.n + 1) * (a.g + 1) / (a.t + 2)) as bigint)))"
    reach = "cast(ceil(12 * sqrt(greatest(0D, a.n * (a.g / greatest(a.t, 1D)) * (1 - a.g / greatest(a.t, 1D)) * (a.t - a.n) / greatest(a.t - 1, 1D)))) as bigint) + 30L"
    none = "cast(array() as array<bigint>)"
    up = f"if(least(b.a.hi, b.m + b.r) > b.m, sequence(b.m + 1, least(b.a.hi, b.m + b.r)), {none})"
    down = f"if(greatest(b.a.lo, b.m - b.r) < b.m, sequence(b.m - 1, greatest(b.a.lo, b.m - b.r), -1L), {none})"
    # the weight of k from that of k - 1, and of k from that of k + 1
    rise = "(c.a.g - k + 1) * (c.a.n - k + 1) / (k * (c.a.t - c.a.g - c.a.n + k))"
    fall = "(k + 1) * (c.a.t - c.a.g - c.a.n + k + 1) / ((c.a.g - k) * (c.a.n - k))"

    def total_of(ks: str, ratio: str) -> str:
        return f"aggregate(c.{ks}, named_struct('w', 1D, 's', 0D), (x, k) -> named_struct('w', x.w * {ratio}, 's', x.s + x.w * {ratio}), x -> x.s)"

    def walk(ks: str, ratio: str, start: str) -> str:
        step = ratio.replace("c.", "d.c.")
        return (
            f"aggregate(d.c.{ks}, named_struct('w', 1D, 's', {start}, 'at', cast(null as bigint)),"
            f" (x, k) -> named_struct('w', x.w * {step}, 's', x.s + x.w * {step}, 'at', if(x.at is null and x.s + x.w * {step} >= d.y, k, x.at)), x -> x.at)"
        )

    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    chosen = f"coalesce(if(d.y <= 1D, d.c.m, null), {walk('up', rise, '1D')}, {walk('down', fall, '1D + d.su')}, d.c.m)"
    drawn = let(
        "d0",
        f"named_struct('c', c, 'su', {total_of('up', rise)}, 'sd', {total_of('down', fall)})",
        let("d", "named_struct('c', d0.c, 'su', d0.su, 'y', d0.c.a.u * (1D + d0.su + d0.sd))", chosen),
    )
    ranges = let("c", f"named_struct('a', b.a, 'm', b.m, 'up', {up}, 'down', {down})", drawn)
    return let("a", at, let("b", f"named_struct('a', a, 'm', {mode}, 'r', {reach})", ranges))


def communication_matrix(counts: DataFrame, capacity: str, seed: int, height: int) -> DataFrame:
    """Draw the matrix. counts: one row with `n`, an array of the rows of each partition, its
    length 2 ** height; capacity: SQL for the array of shard sizes, whose sum is that of n.

    Returns part, to_shard: the exact count for each shard.
    """
    pick = _hypergeometric("x.rest", "element_at(cap, cast(j + 1 as int))", "x.need", _uniform(str(seed), "depth", "node", "j"))
    left = (
        "aggregate(sequence(0L, size(cap) - 1L),"
        " named_struct('need', aggregate(slice(n, 1, cast(size(n) / 2 as int)), 0L, (s, v) -> s + v), 'rest', aggregate(cap, 0L, (s, v) -> s + v), 'got', cast(array() as array<bigint>)),"
        " (x, j) -> element_at(transform(array("
        + pick
        + "), h -> named_struct('need', x.need - h, 'rest', x.rest - element_at(cap, cast(j + 1 as int)), 'got', concat(x.got, array(h)))), 1), x -> x.got)"
    )
    nodes = counts.select(F.lit(0).cast("long").alias("node"), F.col("n"), F.expr(capacity).alias("cap"))
    for depth in range(height):
        if depth == 8:  # from here on there are enough subtrees to share out
            nodes = nodes.repartition("node")
        split = nodes.withColumn("depth", F.lit(depth)).withColumn("got", F.expr(left))
        halves = split.select(
            F.explode(
                F.expr(
                    "array(named_struct('node', 2 * node, 'n', slice(n, 1, cast(size(n) / 2 as int)), 'cap', got),"
                    " named_struct('node', 2 * node + 1, 'n', slice(n, cast(size(n) / 2 as int) + 1, size(n)), 'cap', zip_with(cap, got, (a, b) -> a - b)))"
                )
            ).alias("h")
        )
        nodes = halves.select("h.*")
    return nodes.select(F.col("node").alias("part"), F.col("cap").alias("to_shard"))


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0) to `rows`.

    Shard sizes differ by one at most; every arrangement is equally likely. All columns stay; rows
    that have a column shard or slot (in any case of letters) are refused. Nulls and long values
    are only carried. Equal rows are separate rows. An empty table gives no rows.
    """
    if taken := {c.lower() for c in rows.columns} & {"shard", "slot"}:
        raise ValueError(f"the rows have columns of these names already: {sorted(taken)}")
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("held"))
    held = scratch.put(rows.withColumn("part", F.spark_partition_id().cast("long")).withColumn("row", F.monotonically_increasing_id()), "rows")
    sizes = scratch.put(held.groupBy("part").count(), "sizes")
    last, total = sizes.agg(F.max("part"), F.coalesce(F.sum("count"), F.lit(0))).first()
    height = max(1, int(last or 0).bit_length())
    width = 1 << height
    filled = F.expr(f"transform(sequence(0L, {width - 1}L), p -> coalesce(m[p], 0L))")
    counts = sizes.agg(F.map_from_entries(F.collect_list(F.struct("part", "count"))).alias("m")).select(filled.alias("n"))
    capacity = f"transform(sequence(0, {shards - 1}), s -> {total // shards}L + if(s < {total % shards}, 1L, 0L))"
    matrix = scratch.put(communication_matrix(counts, capacity, seed, height), "matrix")

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")
    dealt = held.withColumn("rank", F.row_number().over(local).cast("long")).join(matrix, "part")
    upto = F.expr("aggregate(to_shard, named_struct('s', 0L, 'i', 0), (x, c) -> named_struct('s', x.s + c, 'i', x.i + if(x.s + c < rank, 1, 0)), x -> x.i)")
    pieces = max(1, -(-total // (shards * RANKED)))
    order = F.xxhash64(F.lit(seed + 2), "row")
    dealt = scratch.put(dealt.drop("rank", "to_shard").withColumn("shard", F.lit(0)) if not total else dealt.withColumn("shard", upto).drop("rank", "to_shard"), "dealt")
    dealt = dealt.withColumn("order", order).withColumn("piece", F.pmod(F.shiftright("order", 7), F.lit(pieces)))
    below = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "piece").count().select("shard", "piece", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy("order", "row")
    placed = dealt.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["shard", "piece"])
    return placed.select("held.*", "shard", (F.col("start") + F.col("nth")).alias("slot"))


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: size 16, the CRC of nothing."""
    utf8 = F.encode(text_or_empty(), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    out = shuffle_into_shards(docs, 40, 20_240_117, Scratch(spark, "op8"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
