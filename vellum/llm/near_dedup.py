"""Near-duplicates: universal hash minima, banding, signature check, full sets, components.

Documents with the same shingle set are one class. A class has `bands` bands of `rows` minima.
Links are looked for so that no group emits all its pairs:

1. In each bucket of a few bands every class is compared with the bucket's smallest class; each
   class tries the centre most like it. What links is joined to components, which is all that a
   large group of close copies needs.
2. Only a bucket of any band whose members are still in different components has pairs left to
   try. In a few turns, each with another member as the centre, the members outside the centre's
   component are compared with the centre.
3. In buckets of any band that are open even then, the members outside the centre's component are compared
   with all members, in blocks of bounded size that hold signatures and sets of 32-bit hashes.
   A member needs one link to each other component, so a block yields few pairs, not all.

A pair goes on to the full sets unless its signatures differ by five standard deviations from
what the threshold asks for, and full sets alone decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL, Scratch, join_facts, listed, own_names, remembered, row_hash, table, text_or_empty, tidied
from .components import connected_components

#: Members outside, and members, that are compared in one block. A task holds the former only.
BLOCK, MEMBERS = 256, 4096
#: Centres that are tried before members are compared with each other.
TURNS = 2
#: Members that meet one centre's set in one group, or each other's in a block at once.
CHUNK = 64
#: Bands of the first step.
FIRST = 8
REMEMBERED = 200_000

_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class WordHashes(dict):
    """64-bit hashes of words. The first ones stay: they hold nearly all the frequent words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of k words; of all words, if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U64)
    w = np.fromiter(map(remembered("words", WordHashes).__getitem__, words), _U64, len(words))
    size = min(k, len(w))
    factors = _mix(np.arange(1, size + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(size)) | _U64(1)
    total = np.zeros(len(w) - size + 1, _U64)
    for i in range(size):
        total += w[i : len(w) - size + 1 + i] * factors[i]
    return np.unique(_mix(total))


class Signer:
    """Minima of `bands * rows` universal hash functions a * x + b mod 2**32."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
        self.mixers = _mix(np.arange(1, rows + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> _U64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 4096):
            np.minimum(least, (self.a * low[None, at : at + 4096] + self.b).min(axis=1), out=least)
        return least

    def keys(self, minima: np.ndarray) -> np.ndarray:
        return _mix((minima.reshape(self.bands, self.rows).astype(_U64) + _U64(1)) @ self.mixers).view(np.int64)


PROFILE = "doc_id long, text_key string, n long, fp binary, bands array<bigint>, sketch binary"


def _profiles(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            n, fp, keys, sketch = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text.as_py(), k)
                least = signer.minima(s)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(signer.keys(least))
                sketch.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(n) + 1, bands, dtype=np.int32)), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), lists, pa.array(sketch, pa.binary())], names=["doc_id", "text_key", "n", "fp", "bands", "sketch"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_or_empty()).alias("text_key"), "text")
    return keyed.mapInArrow(tidied(profile), PROFILE)


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `keys` columns, over batch boundaries."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class _Members:
    """Some rows of a block: cid, component, n, sketch, keys, low, and the band of its bucket."""

    def __init__(self, batch: pa.RecordBatch):
        rows = batch.num_rows
        self.ids, self.components, self.sizes = (batch[c].to_numpy() for c in ("cid", "component", "n"))
        self.band = batch["band"][0].as_py()
        self.sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(rows, -1)
        self.keys = batch["keys"].flatten().to_numpy().reshape(rows, -1)
        self.low = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch["low"]]
        self.linked: list[set[int]] = [set() for _ in range(rows)]

    def copied(self) -> "_Members":
        """Without the batch's memory."""
        self.ids, self.components, self.sizes, self.keys = (x.copy() for x in (self.ids, self.components, self.sizes, self.keys))
        self.low = [x.copy() for x in self.low]
        return self

    def links(self, other: "_Members", num: int, den: int, least: float) -> list[tuple[int, int, float]]:
        """Pairs of these with the others that link by 32-bit hashes, or nearly, and their
        likeness; one is enough for each of these and each other component."""
        goal, out = num / den, []
        fine = self.components[:, None] != other.components[None, :]
        fine &= np.minimum(self.sizes[:, None], other.sizes[None, :]) * den >= np.maximum(self.sizes[:, None], other.sizes[None, :]) * num
        for i in np.nonzero(fine.any(axis=1))[0].tolist():
            js = np.nonzero(fine[i])[0]
            js = js[~(other.keys[js, : self.band] == self.keys[i, : self.band]).any(axis=1)]
            share = (other.sketch[js] == self.sketch[i]).mean(axis=1)
            js, share = js[share >= least], share[share >= least]
            one, linked = self.low[i], self.linked[i]
            for j in js[np.argsort(-share, kind="stable")].tolist():
                if other.components[j] in linked:
                    continue
                two = other.low[j]
                at = np.searchsorted(one, two)
                at[at == len(one)] = 0
                both = int((one[at] == two).sum())
                alike = both / (len(one) + len(two) - both)
                if alike >= goal - 0.01:  # halves of hashes may coincide: full sets decide
                    out.append((min(self.ids[i], other.ids[j]), max(self.ids[i], other.ids[j]), alike))
                if alike >= goal + 0.005:
                    linked.add(other.components[j])
        return out


class NearDuplicates:
    """One search over docs (doc_id, text): link where den * |A and B| >= num * |A or B|.

    Null and empty texts, and texts without words, have an empty set and no links. Ids may be
    null or repeated; other columns are not looked at. An empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, k: int, num: int, den: int, bands: int = 32, rows: int = 5, block: int = BLOCK):
        self.docs, self.scratch, self.k, self.num, self.den, self.bands, self.block = docs, scratch, k, num, den, bands, block
        goal = num / den
        self.least = goal - 5 * (goal * (1 - goal) / (bands * rows)) ** 0.5
        self.profiles = scratch.put(_profiles(docs, k, bands, rows), "profiles")
        some = self.profiles.where("n > 0").groupBy("fp").agg(
            F.first("n").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("min_id"), F.first(F.struct("doc_id", "text_key")).alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        )
        self.classes = scratch.put(some.withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.sets = self.links = self.found = None

    # links -------------------------------------------------------------------------------

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and signatures allow a link, with the share of equal minima."""
        least = self.least
        pairs = self.scratch.put(pairs, "pairs")
        side = self.classes.select("cid", "n", "sketch")
        a, b = (side.select(*[F.col(c).alias(f"{c}_{x}") for c in side.columns]) for x in "ab")
        sized = pairs.join(b, pairs.b == F.col("cid_b")).join(a, pairs.a == F.col("cid_a"))
        sized = sized.where(F.least("n_a", "n_b") * self.den >= F.greatest("n_a", "n_b") * self.num)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                    share = (x == y).mean(axis=1)
                    yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(share)], names=["a", "b", "share"]).filter(pa.array(share >= least))

        return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(tidied(compare), "a long, b long, share double")

    def _with_sets(self, wanted: DataFrame) -> DataFrame:
        """cid, shingles (sorted 64-bit hashes) and low (their upper halves) of the wanted classes;
        each is read from its text once."""
        wanted = wanted.distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cid"), "cid", "left_anti")
        wanted = self.scratch.put(wanted.join(self.classes.select("cid", "rep"), "cid").select("cid", F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key")), "wanted")
        few = wanted.count()
        if not few:
            return self.sets
        wanted = F.broadcast(wanted) if few <= SMALL else wanted.hint("merge")
        k = self.k

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(t.as_py(), k) for t in batch["text"]]
                columns = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([(s >> _U64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch["cid"], *columns], names=["cid", "shingles", "low"])

        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.md5(text_or_empty()))
        texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        new = self.scratch.put(texts.select("cid", "text").mapInArrow(tidied(shingle), "cid long, shingles binary, low binary"), "sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        return self.sets

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets link. A centre's members come in chunks, each of which meets
        one copy of the centre's set; no task holds more than one set beside the current one."""
        sets, num, den = self._with_sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))), self.num, self.den
        if sets is None:
            return pairs.select("a", "b")
        sizes = self.scratch.put(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "sizes")
        members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
        members = members.join(sets, F.col("b") == F.col("cid")).select("a", "chunk", "b", "shingles")
        sets = sets.select("cid", "shingles")
        heads = sizes.join(sets, F.col("a") == F.col("cid")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "shingles")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head = None
            for batch in batches:
                out = []
                for a, b, raw in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["shingles"]):
                    s = np.frombuffer(raw.as_buffer(), _U64)
                    if b is None:
                        head = s.copy()
                        continue
                    at = np.searchsorted(head, s)
                    at[at == len(head)] = 0
                    both = int((head[at] == s).sum())
                    if den * both >= num * (len(s) + len(head) - both):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        met = heads.unionByName(members).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        return met.select("a", "b", "shingles").mapInArrow(tidied(confirm), "a long, b long")

    def _link(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b), and bring the components up to date."""
        pairs = self.scratch.put(pairs.select("a", "b").distinct(), "alike")
        if pairs.isEmpty():
            return
        new = self.scratch.put(self._confirmed(pairs), "links")
        if new.isEmpty():
            return
        self.links = new if self.links is None else self.links.unionByName(new)
        self.found = connected_components(self.links, self.scratch)
        self.scratch.tidy()

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows (cid, ...) with the component that each class is in so far."""
        if self.found is None:
            return rows.withColumn("component", F.col("cid"))
        return rows.join(self.found, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid")).drop("node")

    def _banded(self, some: int) -> DataFrame:
        """bucket, band, cid, component of each class in its first `some` bands."""
        rows = self._placed(self.classes.select("cid", "bands")).select("cid", "component", F.posexplode(F.slice("bands", 1, some)).alias("band", "key"))
        return rows.select(F.xxhash64("band", "key").alias("bucket"), "band", "cid", "component")

    def _open(self, rows: DataFrame, turn: int) -> DataFrame:
        """The buckets with members in several components: size m, how many are outside, a centre
        that depends on the turn, and its component. A bucket of two is done after turn 0."""
        by = F.xxhash64("cid", F.lit(turn))
        size = rows.groupBy("bucket").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.min_by("cid", by).alias("centre"), F.min_by("component", by).alias("own")
        )
        return self.scratch.put(size.where(F.col("lo") != F.col("hi")).where(F.col("m") > (2 if turn else 1)).drop("lo", "hi"), "open")

    def _turn(self, turn: int) -> bool:
        """Compare the members outside with their buckets' centres; whether anything is open."""
        rows = self._banded(self.bands)
        size = self._open(rows, turn)
        if size.isEmpty():
            return False
        outside = rows.join(size, "bucket").where("component != own").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
        alike = self._alike(outside)
        self._link(alike if not turn else alike.groupBy("b").agg(F.max_by("a", "share").alias("a")))
        return True

    def _blocks(self) -> DataFrame | None:
        """Pairs across components that link by 32-bit hashes, or nearly: of each member outside
        one for every other component that has one. None if no bucket is open."""
        least, num, den = self.least, self.num, self.den
        rows = self._banded(self.bands)
        size = self._open(rows, TURNS)
        if size.isEmpty():
            return None
        members = self.scratch.put(rows.join(size, "bucket").select("bucket", "band", "cid", "component", "m", "own"), "members")
        outside = members.where("component != own").groupBy("bucket").agg(F.ceil(F.count("*") / self.block).alias("parts"))
        # a pair is compared in the first band that both share
        sets = self._with_sets(members.select("cid"))
        classes = self.classes.select("cid", "n", "sketch", F.col("bands").alias("keys")).join(sets.select("cid", "low"), "cid")
        members = members.join(outside, "bucket").join(self.scratch.put(classes.join(members.select("cid").distinct(), "cid"), "compared"), "cid")
        chunks = F.ceil(F.col("m") / MEMBERS)
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        spread = lambda n: F.pmod(F.xxhash64("cid"), n)
        facts = ["band", "cid", "component", "n", "sketch", "keys", "low"]
        one = members.where("component != own").select("bucket", spread(F.col("parts")).alias("part"), F.explode(upto(chunks)).alias("chunk"), F.lit(0).alias("role"), *facts)
        two = members.select("bucket", F.explode(upto(F.col("parts"))).alias("part"), F.pmod(F.xxhash64("cid", F.lit(1)), chunks).alias("chunk"), F.lit(1).alias("role"), *facts)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []  # a block, and its members outside; the others pass by, some at a time
            for batch in batches:
                keyed = np.stack([batch[c].to_numpy() for c in ("bucket", "part", "chunk", "role")])
                cuts = np.nonzero((keyed[:, 1:] != keyed[:, :-1]).any(axis=0))[0] + 1
                out = []
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                    if hi == lo:
                        continue
                    if tuple(keyed[:3, lo]) != now:
                        now, held = tuple(keyed[:3, lo]), []
                    for at in range(lo, hi, CHUNK):
                        part = _Members(batch.slice(at, min(CHUNK, hi - at)))
                        if not keyed[3, lo]:
                            held.append(part.copied())
                        else:
                            for some in held:
                                out += some.links(part, num, den, least)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "share"])

        keys = ["bucket", "part", "chunk"]
        placed = one.unionByName(two).repartition(*keys).sortWithinPartitions(*keys, "role")
        return placed.mapInArrow(tidied(compare), "a long, b long, share double")

    def run(self) -> "NearDuplicates":
        first = self._banded(FIRST).select("bucket", "cid")
        centres = self.scratch.put(first.groupBy("bucket").agg(F.min("cid").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m"), "centres")
        pairs = first.join(centres, "bucket").where("a != cid").select("a", F.col("cid").alias("b")).distinct()
        self._link(self._alike(pairs).groupBy("b").agg(F.max_by("a", "share").alias("a")))
        for turn in range(TURNS):
            if not self._turn(turn):
                return self
        pairs = self._blocks()
        if pairs is not None:
            self._link(pairs)
        return self

    # results -----------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """One row per document: doc_id, text_key, n, component_id (the smallest id that can be
        reached; its own without links), root (equal within a component; null without a set)."""
        of = self.classes.select("fp", "cid", "min_id", "rows")
        if self.found is not None:
            of = of.join(self.found, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
        else:
            of = of.withColumn("root", F.col("cid"))
        of = self.scratch.put(of.select("fp", "root", "min_id", "rows"), "roots")
        least = self.scratch.put(of.groupBy("root").agg(F.min("min_id").alias("component_id"), F.count("*").alias("n")), "least")
        of = self.scratch.put(join_facts(of, least, "root", of.count()).select("fp", "root", "component_id", "rows"), "of")
        some = self.profiles.where("n > 0").select("doc_id", "text_key", "n", "fp")
        found = join_facts(some, of, "fp", some.count(), "rows").select("doc_id", "text_key", "n", "component_id", "root")
        none = self.profiles.where("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
        return found.unionByName(none)


def near_dedup_documents(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of `docs` that stay, one per component, with all their columns: that with the
    smallest doc_id, a null id last, then the smallest hash of its text, then of its row.
    Documents without words all stay, but of rows with equal id and text one.

    While no more than SMALL rows go, texts are not shuffled."""
    rows = scratch.put(NearDuplicates(docs, scratch, k, num, den).run().rows(), "rows")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("who")
    some = rows.select("root", who).where("root is not null")
    best = scratch.put(some.groupBy("root").agg(F.min("who").alias("best"), F.count("*").alias("n")).where("n > 1"), "best")
    key, id_, its, hash_, nth = own_names(docs, "text_key", "id", "its_key", "row_hash", "nth")
    named = lambda df: df.select(F.col("who.doc_id").alias(id_), F.col("who.text_key").alias(its)).distinct()
    losers = scratch.put(named(join_facts(some, best, "root", some.count()).where("who != best")), "losers")
    again = scratch.put(named(rows.select(who).groupBy("who").count().where("count > 1")), "again")
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(its))
    kept = docs.withColumn(key, F.md5(text_or_empty())).join(listed(losers), on, "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = listed(again)
    hashed = kept.join(again, on, "left_semi").withColumn(hash_, row_hash(docs))
    once = hashed.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(hash_))).where(F.col(nth) == 1)
    return kept.join(again, on, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def op5_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NearDuplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), k=3, num=85, den=100).run().rows()
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
