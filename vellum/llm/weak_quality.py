"""Quality and toxicity from weak labels: EM over labellers, then a hashed linear scorer.

Labellers vote bad, good or nothing on a text. Expectation-maximisation estimates how often each
is right from how they overlap on all documents; only the counts of vote patterns go to the
driver, whose number is fixed. The posterior labels of a bounded sample train a linear scorer
over hashed words, word beginnings and text shapes, and the scorer decides on every document.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget, own_names, remembered, table, tidied

ABSTAIN, GOOD, BAD = 0, 1, 2

#: Common English insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers trash scum pathetic clown clowns disgusting worthless imbecile imbeciles "
    "dumb dumbass jerk vermin filth scumbag retard pig bitch bastard asshole".split()
)
#: Words in each of which distinct ones are counted; a last part of less than half of it isn't looked at.
SPAN = 4_000
_SYMBOLS = "#$%&*|<>{}[]=+~^_\\@!"
_WORD = re.compile(r"[^\W_]+")
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    sample: int = 24_000  # documents that train the scorer, about
    bits: int = 20
    epochs: int = 12
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-4
    z: float = 3.0  # standard errors from which a feature counts
    least: int = 4  # texts that have it
    prior: float = 0.1  # share of bad texts that the start believes in
    trust: float = 0.995  # accuracy of the annotators
    sure: float = 0.9  # posterior from which a document trains the scorer
    seed: int = 5


def _shares(text: str) -> dict[str, float]:
    """Shares that tell prose from junk; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return dict.fromkeys(("words", "symbols", "bars", "upper", "top", "distinct", "repeats"), 0.0)
    counts = Counter(words)
    parts = [words[at : at + SPAN] for at in range(0, max(1, n - SPAN // 2), SPAN)]
    return {
        "words": float(n),
        "symbols": sum(map(text.count, _SYMBOLS)) / len(text),
        "bars": text.count("|") / n,
        "upper": sum(map(str.isupper, words)) / n,
        "top": max(counts.values()) / n,
        "distinct": sum(len(set(p)) / len(p) for p in parts) / len(parts),  # the mean over spans: it would fall with length
        "repeats": sum(map(eq, words, words[1:])) / n,
    }


def quality_votes(s: dict[str, float]) -> list[int]:
    """Six labellers that each know one kind of junk, and one that knows prose: the absence of
    one kind says nothing of the others. Short texts are judged by fewer of them."""
    n = s["words"]
    junk = [
        s["symbols"] >= 0.03,
        s["bars"] >= 0.05,
        s["upper"] >= 0.4 and n >= 10,
        s["top"] >= 0.3 and n >= 20,
        s["distinct"] <= 0.2 and n >= 40,
        s["repeats"] >= 0.15 and n >= 10,
    ]
    prose = n > 0 and s["symbols"] <= 0.01 and s["bars"] == 0 and (n < 10 or s["upper"] <= 0.15 and s["repeats"] <= 0.05) and (n < 20 or s["top"] <= 0.2)
    return [BAD if j else ABSTAIN for j in junk] + [GOOD if prose else ABSTAIN]


def toxic_votes(words: list[str], lang: str | None) -> list[int]:
    """Two labellers that know English insults; without one, only English texts are good."""
    hits = sum(w in INSULTS for w in words)
    absent = GOOD if lang == "en" else ABSTAIN
    rate = hits / max(1, len(words))
    return [BAD if hits else absent, BAD if rate >= 0.002 else absent if not hits else ABSTAIN]


class Features(dict):
    """word -> its hashed features as 32-bit numbers in bytes: the word, and its first 4, 5 and 6 letters."""

    def __init__(self, bits: int, live: np.ndarray | None = None):
        """live: mask of the features that matter; the others are left out."""
        self.mask, self.live = (1 << bits) - 1, live

    def numbers(self, parts: list[str]) -> bytes:
        ids = [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) & self.mask for p in parts]
        return array("i", ids if self.live is None else [i for i in ids if self.live[i]]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.numbers([word] + [f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k])
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids

    def of(self, words: list[str], shares: dict[str, float], votes: list[int]) -> np.ndarray:
        """Distinct feature numbers of one text."""
        n = min(5, int(shares["words"]).bit_length() // 2)
        shape = [f"{k}={min(12, int(shares[k] * 40))},{n}" for k in ("symbols", "bars", "upper", "top", "repeats")]
        shape += [f"vote {j}={v}" for j, v in enumerate(votes)]
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(words))) + self.numbers(shape), np.int32))


def em(patterns: dict[tuple[int, ...], int], labellers: int, prior: float, trust: float, silence: bool, rounds: int = 60) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of bad for each pattern of votes, and table[labeller, class, vote].

    Each labeller has its own vote probabilities given the true class (0 good, 1 bad), and votes
    are independent given it. The start believes each labeller, and a few made-up votes of that
    kind stay, so that classes can't swap and empty cells are harmless. The last labeller are the
    annotators: `trust` is their accuracy and isn't estimated, as in some languages no other
    labeller votes that could tell their mistakes. silence: whether no vote is evidence too, as
    with labellers that only ever vote bad; otherwise it is left out of account.
    """
    keys = np.array(list(patterns) or [[0] * labellers], int).reshape(-1, labellers)
    times = np.array(list(patterns.values()) or [0], float)
    believed = np.array([[0.4, 0.55, 0.05], [0.4, 0.05, 0.55]])
    table_ = np.repeat(believed[None], labellers, axis=0)
    table_[-1] = [[0.5, trust / 2, (1 - trust) / 2], [0.5, (1 - trust) / 2, trust / 2]]
    if not silence:
        table_[:, :, ABSTAIN] = 1.0
    bad = prior
    post = np.full(len(keys), prior)
    for _ in range(rounds):
        logs = np.log(table_[np.arange(labellers)[:, None], :, keys.T]).sum(axis=0)  # pattern, class
        odds = logs[:, 1] - logs[:, 0] + np.log(bad / (1 - bad))
        post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        bad = float(np.clip((times @ post + 10 * prior) / (times.sum() + 10), 1e-4, 1 - 1e-4))
        for j in range(labellers - 1):
            for y, weight in ((0, times * (1 - post)), (1, times * post)):
                votes = np.bincount(keys[:, j], weight, 3) + 10 * believed[y]
                table_[j, y] = votes / (votes if silence else votes[1:]).sum()
                if not silence:
                    table_[j, y, ABSTAIN] = 1.0
    return {tuple(int(x) for x in k): float(p) for k, p in zip(keys, post)}, table_


class Linear:
    """Two logistic scorers over the same binary features: low quality, and toxic."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @staticmethod
    def telling(ids: list[np.ndarray], labels: np.ndarray, size: int, s: Settings) -> np.ndarray:
        """Mask of the features that speak for bad: log odds above 0 by s.z standard errors, in
        enough texts. The rest say nothing or only that a text is a usual one: each would add
        little, but a long text has thousands of them."""
        good, bad = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for one, label in zip(ids, labels):
            (bad if label > 0.5 else good)[one] += 1  # a text's features are distinct
        odds = np.log((bad + 0.5) / ((labels > 0.5).sum() + 1)) - np.log((good + 0.5) / ((labels <= 0.5).sum() + 1))
        return (odds >= s.z * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))) & (good + bad >= s.least)

    @classmethod
    def train(cls, ids: list[np.ndarray], labels: np.ndarray, s: Settings) -> "Linear":
        """labels: (n, 2) with NaN where unknown. AdaGrad over shuffled batches."""
        rng, size = np.random.default_rng(s.seed), 1 << s.bits
        weights, bias = np.zeros((2, size)), np.zeros(2)
        for h in range(2):
            rows = np.nonzero(~np.isnan(labels[:, h]))[0]
            if len(rows) == 0 or len(set(labels[rows, h] > 0.5)) < 2:
                bias[h] = -20.0  # nothing to tell apart: nothing is rejected
                continue
            mask = cls.telling([ids[i] for i in rows], labels[rows, h], size, s)
            own = {i: ids[i][mask[ids[i]]] for i in rows}
            w, seen, b, b_seen = weights[h], np.full(size, 1e-8), -0.5, 1e-8
            for _ in range(s.epochs):
                rng.shuffle(rows)
                for at in range(0, len(rows), s.batch):
                    part = rows[at : at + s.batch]
                    flat = np.concatenate([own[i] for i in part])
                    doc = np.repeat(np.arange(len(part)), [len(own[i]) for i in part])
                    logit = np.bincount(doc, w[flat], len(part)) + b
                    off = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[part, h]
                    used, inverse = np.unique(flat, return_inverse=True)
                    g = np.bincount(inverse, off[doc], len(used)) + s.decay * w[used]
                    seen[used] += g * g
                    w[used] -= s.rate * g / np.sqrt(seen[used])
                    b_seen += off.sum() ** 2
                    b = min(b - s.rate * off.sum() / np.sqrt(b_seen), -0.5)  # a text without any telling feature is kept
            bias[h] = b
        return cls(weights.astype(np.float32), bias)

    def score(self, ids: np.ndarray) -> np.ndarray:
        logit = self.weights[:, ids].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


class QualityModel:
    """docs: doc_id, text, lang; labels: doc_id, quality, toxic (may be empty). Null texts are
    empty, and texts without words are kept; a null lang is no language. Several labels of one
    id count as the worst of them."""

    def __init__(self, docs: DataFrame, labels: DataFrame, scratch: Scratch, settings: Settings = Settings()):
        self.settings, self.spark = settings, docs.sparkSession
        votes = scratch.put(self._votes(docs), "votes")
        marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        mark = lambda name, good: F.when(F.col(name).isNull(), ABSTAIN).when(F.col(name) == good, GOOD).otherwise(BAD)
        rows = votes.join(marks.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
        rows = rows.withColumn("q", F.concat(F.col("quality_votes"), F.array(mark("quality", 1)))).withColumn("t", F.concat(F.col("toxic_votes"), F.array(mark("toxic", 0))))
        rows = scratch.put(rows.select("doc_id", "q", "t", "features"), "marked")
        self.posteriors, self.accuracy = {}, {}
        for name, labellers, silence in (("q", 8, True), ("t", 3, False)):  # 3 ** labellers rows at most
            found = {tuple(r[name]): r["count"] for r in rows.groupBy(name).count().collect()}
            self.posteriors[name], self.accuracy[name] = em(found, labellers, settings.prior, settings.trust, silence)
        self.linear = self._train(rows)

    def _votes(self, docs: DataFrame) -> DataFrame:
        """doc_id, the votes, and for about settings.sample documents their features."""
        s, count = self.settings, docs.count()
        share = int(min(1.0, s.sample / max(1, count)) * (1 << 32))
        ints = pa.list_(pa.int32())

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = remembered(f"features of {s.bits} bits", lambda: Features(s.bits))
            for batch in batches:
                q, t, f = [], [], []
                for doc_id, lang, text in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), batch["text"]):
                    text = text.as_py() or ""
                    words, shares = _WORD.findall(text.lower()), _shares(text)
                    q.append(quality_votes(shares))
                    t.append(toxic_votes(words, lang))
                    seen = q[-1] + toxic_votes(words, None)
                    drawn = xxhash.xxh32_intdigest(f"{doc_id}:{zlib.crc32(text.encode('utf-8', 'surrogatepass'))}") < share
                    f.append(features.of(words, shares, seen) if drawn else None)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(q, ints), pa.array(t, ints), pa.array(f, ints)], names=["doc_id", "quality_votes", "toxic_votes", "features"])

        ddl = "doc_id long, quality_votes array<int>, toxic_votes array<int>, features array<int>"
        return _texts(docs).mapInArrow(tidied(vote), ddl)

    def _train(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the features that have a weight, their weights, and the biases."""
        s, posteriors = self.settings, self.posteriors

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            ids, labels = [], []
            for batch in batches:
                for q, t, f in zip(batch["q"].to_pylist(), batch["t"].to_pylist(), batch["features"]):
                    post = [posteriors["q"][tuple(q)], posteriors["t"][tuple(t)]]
                    sure = [p if max(p, 1 - p) >= s.sure else np.nan for p in post]
                    if not all(np.isnan(sure)):
                        ids.append(np.asarray(f.values))
                        labels.append(sure)
            m = Linear.train(ids, np.array(labels).reshape(-1, 2), s)
            used = np.nonzero(m.weights.any(axis=0))[0].astype(np.int32)
            columns = [used.tobytes(), m.weights[:, used].tobytes(), m.bias.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["used", "weights", "bias"])

        sample = rows.where("features is not null").select("q", "t", "features").coalesce(1)
        got = sample.mapInArrow(tidied(train), "used binary, weights binary, bias binary").collect()  # one model, its features with a weight
        if not got:
            return np.empty(0, np.int32), np.empty((2, 0), np.float32), np.full(2, -20.0)
        used = np.frombuffer(got[0]["used"], np.int32)
        return used, np.frombuffer(got[0]["weights"], np.float32).reshape(2, len(used)), np.frombuffer(got[0]["bias"])

    def scored(self, docs: DataFrame, low: str = "p_low", toxic: str = "p_toxic") -> DataFrame:
        """All columns of docs, with the scorer's probabilities under the two names."""
        (used, weights, bias), bits = self.linear, self.settings.bits
        at, own = [c.lower() for c in docs.columns].index("text"), f"features with a weight {uuid.uuid4().hex}"
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            linear = Linear(np.zeros((2, 1 << bits), np.float32), bias)
            linear.weights[:, used] = weights
            features = remembered(own, lambda: Features(bits, (linear.weights != 0).any(axis=0)))
            for batch in batches:
                p = np.zeros((batch.num_rows, 2))
                for i, text in enumerate(batch.column(at)):
                    text = text.as_py() or ""
                    words, shares = _WORD.findall(text.lower()), _shares(text)
                    if shares["words"]:
                        p[i] = linear.score(features.of(words, shares, quality_votes(shares) + toxic_votes(words, None)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*batch.schema.names, low, toxic])

        return docs.mapInArrow(tidied(score), f"{kinds}, `{low}` double, `{toxic}` double")


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))


def accepted_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that the scorer finds neither low in quality nor toxic."""
    low, toxic = own_names(docs, "p_low", "p_toxic")
    scored = QualityModel(docs, labels, scratch).scored(docs, low, toxic)
    return scored.where((F.col(low) < 0.5) & (F.col(toxic) < 0.5)).select(docs.columns)


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = QualityModel(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op10"))
    low, toxic = F.col("p_low") >= 0.5, F.col("p_toxic") >= 0.5
    got = model.scored(docs.select("doc_id", "text"))
    return got.select("doc_id", "p_low", "p_toxic", low.alias("low_quality"), toxic.alias("toxic"), (~low & ~toxic).alias("kept"))
