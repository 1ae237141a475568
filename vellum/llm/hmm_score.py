"""Scoring texts by a hidden Markov language model trained with Baum-Welch.

The model's symbols are the most frequent training words (all those with some count or more), an
end of text, and classes of all other words. Both head and classes grow with the square root of
the vocabulary: the model gets larger with the corpus, and still fits a task when the vocabulary
has ten thousand million words. Given its class, a word outside the head has its share of the
class's training counts, whatever the state. So the probability of a text is the exact one of its
symbols, from the scaled forward recursion, times that of each rarer word in its class. Rarer
words meet their counts in a join.

Training: the documents are dealt into slices by hash. In the first rounds each slice's expected
counts move the model a little (stepwise Baum-Welch), so a round improves it as often as there are
slices; then passes over all documents set the parameters, until the likelihood of all of them
hardly grows. Every round and pass sums the expected counts of every training document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

#: The end of a text among the counted tokens; words are never empty.
END = b""
EXTRA = 0.1
#: A task hands on its counts when it holds so many different words.
HELD = 300_000


@dataclass(frozen=True)
class Settings:
    states: int = 12
    head: float = 80.0  # words in the head, and
    classes: float = 0.1  # classes of the others, for each root of the vocabulary's size
    slices: int = 8
    rounds: int = 1  # over the slices
    decay: float = 0.7  # the n-th step moves the counts by (n + 1) ** -decay
    passes: int = 3  # over all documents at once, at most
    gain: float = 1e-3  # training stops when a pass adds less to the log likelihood of a token
    piece: int = 2_048  # training cuts longer texts, which bounds its memory; scoring does not
    batch_tokens: int = 400_000
    ranges: int = 16  # of symbols, in which tasks' counts are added up
    seed: int = 11


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: int | None) -> bool:
    """A null id has the remainder 0: it is never trained on."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: counts over all training documents, the end of text included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])
            seen.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if not held_out(doc_id):
                    seen.update(tokens(text.as_py()))
                    seen[END] += 1
                    if len(seen) > HELD:
                        yield out()
        yield out()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


class Symbols:
    """word -> symbol: 0 is the end, then the head by rank, then the classes of rarer words."""

    def __init__(self, head: list[bytes], classes: int):
        self.ids = {END: 0} | {w: i + 1 for i, w in enumerate(head)}
        self.first_class, self.classes = len(head) + 1, classes
        self.size = self.first_class + classes

    def of(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Symbols of the words with the end, and the words that are only known by class."""
        get, rare = self.ids.get, []
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        for i in np.nonzero(ids < 0)[0]:
            rare.append(words[i])
            ids[i] = self.first_class + zlib.crc32(words[i]) % self.classes
        return np.append(ids, np.int32(0)), rare


class Hmm:
    """start (K), move (K, K), emit (symbols, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit, self.seen, self._single = start, move, emit, 0.0, None

    @classmethod
    def fresh(cls, states: int, unigrams: np.ndarray, seed: int) -> "Hmm":
        rng = np.random.default_rng(seed)
        emit = (unigrams + EXTRA)[:, None] * rng.gamma(2.0, 0.5, (len(unigrams), states))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigrams: np.ndarray) -> "Hmm":
        """Expected counts, each with a little of a prior, so that no probability is 0."""
        states = len(start)
        base = (unigrams + EXTRA) / (unigrams + EXTRA).sum()
        start, move = start + 0.1, move + 0.1 + np.eye(states)
        emit = emit + 25.0 * base[:, None]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each sequence. Sequences run side by side, longest
        first, so the ones that are over drop off the end."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        total, alpha = np.zeros(len(lengths)), None
        for t, n in enumerate(live):
            alpha = (self.start if alpha is None else alpha[:n] @ self.move) * self.emit[flat[starts[:n] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        out = np.empty(len(lengths))
        out[order] = total
        return out

    def expected(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over the sequences. Their log likelihood
        is added to `seen`. Sequences run side by side, a column each; single precision, as the
        counts are only estimates."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        ends = np.cumsum(live).tolist()
        symbols = flat[np.concatenate([starts[:n] + t for t, n in enumerate(live)])]
        live = live.tolist()
        states, move = len(self.start), self.move.astype(np.float32)
        forth, first = np.ascontiguousarray(move.T), self.start.astype(np.float32)[:, None]
        e = np.ascontiguousarray(self._emit32()[symbols].T)
        alpha, scales = np.empty_like(e), np.empty(e.shape[1], np.float32)
        before = 0
        for n, hi in zip(live, ends):
            lo = hi - n
            now = alpha[:, lo:hi]
            np.multiply(forth @ alpha[:, before : before + n] if lo else first, e[:, lo:hi], out=now)
            scales[lo:hi] = now.sum(axis=0)
            now /= scales[lo:hi]
            before = lo
        self.seen += float(np.log(scales.astype(np.float64)).sum())
        e /= scales
        moved, beta = np.zeros_like(self.move), np.ones((states, 0), np.float32)
        for n, hi in zip(reversed(live), reversed(ends)):
            lo, m = hi - n, beta.shape[1]
            now = np.ones((states, n), np.float32)
            if m:  # sequences that go on
                weighed = e[:, hi : hi + m] * beta
                now[:, :m] = move @ weighed
                moved += alpha[:, lo : lo + m] @ weighed.T
            beta = now
            alpha[:, lo:hi] *= now  # now the posterior of the states
        emit = np.stack([np.bincount(symbols, row, len(self.emit)) for row in alpha], axis=1)
        return alpha[:, : live[0]].sum(axis=1, dtype=np.float64), moved * self.move, emit

    def _emit32(self) -> np.ndarray:
        if self._single is None:
            self._single = self.emit.astype(np.float32)
        return self._single


def _pieces(starts: np.ndarray, lengths: np.ndarray, piece: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and lengths of the sequences for training, those over `piece` tokens in several
    parts; in groups of about `most` tokens with similar lengths."""
    parts = -(-lengths // piece)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, left = np.repeat(starts, parts) + nth * piece, np.repeat(lengths, parts) - nth * piece
    lengths = np.minimum(left, piece)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    at, ends = 0, np.cumsum(lengths)
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield starts[at:to], lengths[at:to]
        at = to


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all rows, and each row's start and length."""
    column = batch["symbols"]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.int32)
    return flat, (offsets[:-1] - offsets[0]) // 4, np.diff(offsets) // 4


class HmmModel:
    """Trained on docs (doc_id, text); scores rows of such tables."""

    def __init__(self, docs: DataFrame, scratch: Scratch, settings: Settings = Settings()):
        self.scratch, self.settings = scratch, settings
        self.spark = docs.sparkSession
        s = settings
        self.counts = scratch.put(word_counts(docs), "counts")
        n, v = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(n), int(v)
        self.classes, head = (max(1, math.ceil(x * math.sqrt(self.v))) for x in (s.classes, s.head))
        # the least count that at most `head` words reach: the head is what the driver gets
        tally = self.counts.where(F.col("word") != F.lit(END)).groupBy("c").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        least = tally.withColumn("upto", upto).where(F.col("upto") <= head).agg(F.min("c")).first()[0]
        words = [] if least is None else sorted(self.counts.where((F.col("c") >= least) & (F.col("word") != F.lit(END))).collect(), key=lambda r: (-r["c"], r["word"]))
        self.head_counts = np.array([0] + [r["c"] for r in words], np.int64)
        self.head_counts[0] = self.counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        self.symbols = Symbols([bytes(r["word"]) for r in words], self.classes)
        self._tail(words)
        unigrams = np.concatenate([self.head_counts, self.class_n]).astype(float)
        self.unigrams = unigrams
        self.documents = scratch.put(self._encoded(docs), "symbols", "slice")
        self.model = self._train()

    def _tail(self, words: list) -> None:
        """Tokens and types of each class among the words outside the head."""
        cls = F.pmod(F.crc32("word"), F.lit(self.classes))
        n, v = np.zeros(self.classes, np.int64), np.zeros(self.classes, np.int64)
        for k, tokens_, types in self.counts.where(F.col("word") != F.lit(END)).groupBy(cls).agg(F.sum("c"), F.count("*")).collect():  # one row a class
            n[k], v[k] = tokens_, types
        for r in words:
            k = zlib.crc32(r["word"]) % self.classes
            n[k] -= r["c"]
            v[k] -= 1
        self.class_n, self.class_v = n, v

    def base_log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + EXTRA) / (self.n + EXTRA * (self.v + 1)))

    def _encoded(self, docs: DataFrame) -> DataFrame:
        """row, slice, doc_id, held_out, symbols (as bytes: every pass reads them, and lists would be
        taken apart value by value), rare (words outside the head), head_base, head_known."""
        symbols, known = self.symbols, np.concatenate([self.head_counts, np.zeros(self.classes, np.int64)])
        base = np.concatenate([self.base_log10(self.head_counts), np.zeros(self.classes)])
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("symbols", pa.binary()), ("rare", pa.list_(pa.binary())), ("head_base", pa.float64()), ("head_known", pa.int64())])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    rows, out = batch.slice(at, 1000), []
                    for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"]):
                        ids, rare = symbols.of(tokens(text.as_py()))
                        out.append((doc_id, held_out(doc_id), ids.astype("<i4").tobytes(), rare, float(base[ids].sum()), int((known[ids] > 0).sum())))
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

        ddl = "doc_id long, held_out boolean, symbols binary, rare array<binary>, head_base double, head_known long"
        coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ddl)
        return coded.withColumn("row", F.monotonically_increasing_id()).withColumn("slice", F.pmod(F.xxhash64("doc_id", "symbols"), F.lit(self.settings.slices)).cast("int"))

    def _expected(self, rows: DataFrame, model: Hmm) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float, int]:
        """Expected counts over rows, their log likelihood, and their tokens. Each task sums its
        own; sums meet by ranges of symbols, so that what the driver gets is one model's worth."""
        shared, states, size = self.spark.sparkContext.broadcast((model.start, model.move, model.emit)), self.settings.states, self.symbols.size
        piece, most, ranges = self.settings.piece, self.settings.batch_tokens, self.settings.ranges
        edges = np.linspace(0, size, ranges + 1).astype(int).tolist()
        schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total, n = Hmm(*shared.value), None, 0
            for batch in batches:
                flat, starts, lengths = _sequences(batch)
                n += len(flat)
                for group in _pieces(starts, lengths, piece, most):
                    got = m.expected(flat, *group)
                    total = got if total is None else tuple(x + y for x, y in zip(total, got))
            if total is not None:
                rest = np.concatenate([total[0], total[1].ravel(), [m.seen, n]])
                parts = [total[2][lo:hi].astype(np.float32).tobytes() for lo, hi in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(range(ranges + 1), pa.int32()), pa.array([*parts, rest.tobytes()], pa.binary())], schema=schema)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, data in zip(batch["part"].to_pylist(), batch["counts"]):
                    new = np.frombuffer(data.as_buffer(), np.float64 if part == ranges else np.float32)
                    sums[part] = sums[part] + new if part in sums else new.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=schema)

        each = rows.select("symbols").mapInArrow(expect, "part int, counts binary")
        got = {r["part"]: np.frombuffer(r["counts"]) for r in each.repartition(ranges + 1, "part").mapInArrow(add, "part int, counts binary").collect()}  # one model
        shared.unpersist()
        if not got:
            return (np.zeros(states), np.zeros((states, states)), np.zeros((size, states))), 0.0, 0
        rest = got[ranges]
        emit = np.concatenate([got[i] for i in range(ranges)]).reshape(size, states)
        return (rest[:states], rest[states:-2].reshape(states, states), emit), float(rest[-2]), int(rest[-1])

    def _train(self) -> Hmm:
        s = self.settings
        model = Hmm.fresh(s.states, self.unigrams, s.seed)
        training = self.documents.where("not held_out")
        if not self.n:
            return model
        held, steps = None, 0
        for k in [k for _ in range(s.rounds) for k in range(s.slices)]:
            counts, _, n = self._expected(training.where(F.col("slice") == k), model)
            if n:
                steps += 1
                share = steps**-s.decay
                counts = [x * (self.n / n) for x in counts]
                held = counts if held is None else [(1 - share) * old + share * new for old, new in zip(held, counts)]
                model = Hmm.from_counts(*held, self.unigrams)
        self.scratch.tidy()
        self.likelihoods: list[float] = []  # of a token, before each pass
        while len(self.likelihoods) < s.passes:
            counts, seen, _ = self._expected(training, model)
            model = Hmm.from_counts(*counts, self.unigrams)
            self.likelihoods.append(seen / self.n)
            self.scratch.tidy()
            if len(self.likelihoods) > 1 and self.likelihoods[-1] - self.likelihoods[-2] < s.gain:
                break
        return model

    def scores(self) -> DataFrame:
        """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
        score. Null and empty texts are an end of text alone. Both scores are log10 probabilities
        of all tokens; a word without training counts has one unseen word's share."""
        shared = self.spark.sparkContext.broadcast((self.model.start, self.model.move, self.model.emit))
        log10 = np.log(10.0)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Hmm(*shared.value)
            for batch in batches:
                flat, starts, lengths = _sequences(batch)
                out = m.forward(flat, starts, lengths) / log10
                names = ["row", "doc_id", "held_out", "head_base", "head_known"]
                yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(lengths), pa.array(out)], names=[*names, "n_tokens", "head_score"])

        ddl = "row long, doc_id long, held_out boolean, head_base double, head_known long, n_tokens long, head_score double"
        heads = self.documents.select("row", "doc_id", "held_out", "head_base", "head_known", "symbols").mapInArrow(score, ddl)
        rare = self.documents.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
        met = rare.join(self.counts.hint("merge"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        facts = self.spark.createDataFrame(pa.table({"cls": pa.array(range(self.classes), pa.int64()), "n_g": self.class_n.astype(float), "v_g": self.class_v.astype(float)}))
        met = met.withColumn("cls", F.pmod(F.crc32("word"), F.lit(self.classes).cast("long"))).join(F.broadcast(facts), "cls")  # a root of the vocabulary's size
        inside = F.log10((F.col("c") + EXTRA) / (F.col("n_g") + EXTRA * (F.col("v_g") + 1)))
        base = F.log10((F.col("c") + EXTRA) / (F.lit(float(self.n)) + EXTRA * (self.v + 1)))
        tails = met.groupBy("row").agg(F.sum(F.col("times") * base).alias("base"), F.sum(F.col("times") * inside).alias("inside"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
        got = heads.join(tails, "row", "left")
        zero = F.lit(0.0)
        return got.select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(self.n).cast("long").alias("train_tokens"),
            (F.col("head_base") + F.coalesce("base", zero)).alias("base_score"),
            (F.col("head_score") + F.coalesce("inside", zero)).alias("score"),
        )


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HmmModel(table(spark, sf_dir, "documents"), Scratch(spark, "op3")).scores()
