"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Every document of a source should be taken target / source_size times. The whole part is taken
outright. The fractional parts are probabilities, and they are rounded in pairs: of two documents
one passes words to the other, either way at random and with no change in expectation, until one
of them is at 0 or 1. A pair keeps its sum of words, so a source keeps its total. Bounded chunks
of a source fold into one open document each; those meet in chunks again, level by level, until
a source has a single open document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, listed, own_names, row_hash, table, text_or_empty

#: Documents that meet in one fold, on average.
FAN_IN = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """sizes: source, source_size. Adds target.

    The weights repeat over the sources in code-point order, null last. A target stops at `most`
    times the source's size; what is over goes to the others by weight until none is above. In
    order of cap over weight that ends where the share left per weight falls below the next cap.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("share", share).withColumn("capped", F.col("share") * F.col("weight") > F.col("cap"))
    level = F.min_by(F.when(~F.col("capped"), F.col("share")), F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(everything)
    return s.select("source", "source_size", F.least(F.coalesce(level * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _pivot(seed: int, level: int) -> str:
    """SQL that folds `items` (p, size, key, ...) into struct(open, done): one document that is
    still open, and the others with p at 0 or 1."""
    give = "least((1 - x.open.p) * x.open.size, d.p * d.size)"  # words that d may pass to the open one
    take = "least(x.open.p * x.open.size, (1 - d.p) * d.size)"  # and back
    u = f"((xxhash64({seed}, {level}, x.open.key, d.key) & 9007199254740991L) + 0.5D) / 9007199254740992D"

    def moved(name: str, p: str) -> str:
        return f"named_struct('p', {p}, 'size', {name}.size, 'key', {name}.key, 'item', {name}.item)"

    def settled(first: str, to: str, open_p: str, other_to: str, other_p: str) -> str:
        return (
            f"if({first}, named_struct('open', {moved('d', open_p)}, 'done', concat(x.done, array({moved('x.open', to)}))),"
            f" named_struct('open', {moved('x.open', other_p)}, 'done', concat(x.done, array({moved('d', other_to)}))))"
        )

    to_open = settled("(1 - x.open.p) * x.open.size <= d.p * d.size", "1D", f"greatest(0D, d.p - {give} / d.size)", "0D", f"least(1D, x.open.p + {give} / x.open.size)")
    to_other = settled("x.open.p * x.open.size <= (1 - d.p) * d.size", "0D", f"least(1D, d.p + {take} / d.size)", "1D", f"greatest(0D, x.open.p - {take} / x.open.size)")
    step = f"if({u} * ({give} + {take}) < {take}, {to_open}, {to_other})"
    none = "slice(items, 1, 0)"
    return f"aggregate(slice(items, 2, size(items)), named_struct('open', items[0], 'done', {none}), (x, d) -> {step})"


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...], most: float, seed: int, scratch: Scratch) -> DataFrame:
    """How often each row of `docs` (doc_id, text, source) is taken.

    Returns one row per row of docs: doc_id, source, key (a hash of the text), size,
    source_size, target, taken, copies. Sources with null names are one source. A document is
    taken floor or ceil of target / source_size times; of each source the one document that is
    left open at the end is taken as a whole with the probability that it is left with, so all
    copies are whole ones. Sizes of 0 are taken 0 times. Equal
    rows (same id and text) are rounded together and then told apart by number, so the result
    is the same however the rows are spread.
    """
    held = docs.select("doc_id", "source", F.xxhash64(text_or_empty()).alias("key"), size.cast("long").alias("size"))
    rows = scratch.put(held.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("same")), "rows")
    sizes = scratch.put(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"), F.count("*").alias("docs")), "sizes")
    targets = source_targets(sizes, weights, most)
    goals = scratch.put(targets.join(sizes.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "goals")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(ratio + 1e-12)
    odd = F.greatest(F.lit(0.0), ratio - base) * F.col("same")
    rows = rows.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("base", base).withColumn("more", F.floor(odd + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), odd - F.col("more")))
    item = ["doc_id", "source", "key", "size", "same", "source_size", "target", "base", "more"]
    rows = rows.select("p", "size", "key", "docs", F.struct(*item).alias("item"))

    fractional = (F.col("p") > 1e-9) & (F.col("size") > 0)
    rows = scratch.put(rows, "level")
    done = [rows.where(~fractional).select(F.lit(0.0).alias("p"), "item", F.lit(False).alias("last"))]
    rows, level, most_docs = rows.where(fractional), 0, goals.agg(F.max("docs")).first()[0] or 0
    while most_docs > 1:
        level += 1
        chunks = F.ceil(F.col("docs") / FAN_IN)
        chunk = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "item.doc_id", "key"), chunks)
        entries = F.sort_array(F.collect_list(F.struct("p", "size", "key", "item")))
        folds = rows.groupBy(F.col("item.source").alias("source"), chunk.alias("chunk")).agg(F.max(chunks).alias("docs"), entries.alias("items"))
        folds = scratch.put(folds.select("docs", F.expr(_pivot(seed, level)).alias("f")), "level")
        done.append(folds.select(F.explode("f.done").alias("d")).select("d.p", "d.item", F.lit(False).alias("last")))
        rows = folds.select("f.open.p", "f.open.size", "f.open.key", "docs", "f.open.item")
        most_docs = 0 if most_docs <= 1 else -(-most_docs // FAN_IN)
    done.append(rows.select("p", "item", F.lit(True).alias("last")))

    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    chance = (F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "item.doc_id", "item.key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    part = F.when(F.col("p") > 1 - 1e-9, 1.0).when(F.col("p") < 1e-9, 0.0).otherwise((chance < F.col("p")).cast("double"))
    out = out.select("item.*", part.alias("part")).withColumn("nth", F.explode(F.expr("sequence(1L, same)")))
    extra = F.when(F.col("nth") <= F.col("more"), 1.0).when(F.col("nth") == F.col("more") + 1, F.col("part")).otherwise(0.0)
    out = out.withColumn("copies", F.col("base") + extra)
    return out.select("doc_id", "source", "key", "nth", "size", "source_size", "target", F.round(F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...], most: float, seed: int, scratch: Scratch) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, all columns kept. Which of
    several rows with one id, source and text are taken goes by the hash of the row.

    While the plan has no more than SMALL rows, texts are not shuffled."""
    plan = mix(docs, word_count(), weights, most, seed, scratch)
    plan = scratch.put(plan.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("source").alias("_source"), "nth", "copies"), "plan")
    many = scratch.put(plan.where("nth > 1").select("_id", "_key", "_source").distinct(), "many")
    plan = plan.where("copies >= 1").select("_id", "_key", "_source", F.col("nth").alias("_nth"), F.col("copies").cast("int").alias("_copies"))
    key, nth, hash_, its, id_, source, no, copies, copy = own_names(docs, "key", "nth", "hash", "its", "id", "its_source", "no", "copies", "copy")
    renamed = {"_id": id_, "_key": its, "_source": source, "_nth": no, "_copies": copies}
    plan, many = (df.withColumnsRenamed(renamed) for df in (plan, many))
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(its)) & F.col("source").eqNullSafe(F.col(source))
    rows = docs.withColumn(key, F.xxhash64(text_or_empty()))
    if many.isEmpty():
        got = rows.join(listed(plan), on)
    else:  # only rows that share id, source and text are put in order
        many = listed(many)
        order = Window.partitionBy("doc_id", key, "source").orderBy(hash_)
        some = rows.join(many, on, "left_semi").withColumn(hash_, row_hash(docs)).withColumn(nth, F.row_number().over(order)).drop(hash_)
        rows = rows.join(many, on, "left_anti").withColumn(nth, F.lit(1)).unionByName(some)
        got = rows.join(listed(plan), on & (F.col(nth) == F.col(no)))
    return got.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"), word_count(), (5, 2, 1), 3.0, 7_041, Scratch(spark, "op7"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
