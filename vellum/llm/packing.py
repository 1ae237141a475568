"""Best-fit packing of token sequences by exact complements.

Only the histogram of piece lengths goes to the driver: at most `room` numbers, however many
documents there are. The plan made from it is a list of patterns, each with a multiplicity, and
a piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, remembered, table, tidied

#: What may follow a letter or digit as a token of its own.
_TAIL = ".,;:!?%&$*#|"


class _Chunks(dict):
    """Ids of chunks, each behind `before`, worked out when first asked for. The first
    `remembered` stay: they hold nearly all the frequent ones."""

    def __init__(self, tokenizer, before: str, tails: "_Chunks | None", remembered: int):
        self.tokenizer, self.before, self.remembered = tokenizer, before, remembered
        self.tails = self if tails is None else tails

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(_TAIL)
        if core and core != chunk and core[-1].isalnum():  # the pre-tokenizer splits there
            ids = self[core] + self.tails[chunk[len(core) :]]
        else:
            ids = array("I", self.tokenizer.encode(self.before + chunk, add_special_tokens=False).ids).tobytes()
        if len(self) < self.remembered:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Byte-level BPE ids as 32-bit words, from what it remembers of space-separated chunks.

    A byte-level pre-tokenizer never merges across the start of " word", so in texts whose words
    stand between single spaces or line feeds each chunk has ids of its own. Other texts, and those
    that hold the string of an added token, are encoded whole.
    """

    def __init__(self, path: str, remembered: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = _Chunks(self.tokenizer, "", None, remembered // 4)
        self.spaced = _Chunks(self.tokenizer, " ", self.plain, remembered)
        self.line = self.plain["\n"]

    def encode(self, text: str) -> bytes:
        lines = [line.split(" ") for line in text.split("\n")]
        if text.split() != [chunk for line in lines for chunk in line] or any(map(text.__contains__, self.added)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        plain, spaced = self.plain, self.spaced.__getitem__
        return self.line.join([plain[line[0]] + b"".join(map(spaced, line[1:])) for line in lines])


def encoder(path: str | None, chunks: int = 400_000) -> ChunkEncoder:
    """One encoder for each worker process: later tasks profit from what earlier ones learned."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    encoders = remembered("encoders", dict)
    if (path, chunks) not in encoders:
        encoders[path, chunks] = ChunkEncoder(path, chunks)
    return encoders[path, chunks]


PIECES = "doc_id long, doc long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, room: int, end_id: int, tokenizer: str | None = None, keep_ids: bool = False, chunks: int = 400_000) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): null text is empty, and an empty
    text is the end token alone. Longer documents are cut from their end, so that only the first
    piece is short. part and nth: the task, and the number among its pieces of this length. chunks:
    how many of them a worker remembers."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder, seen, doc = TaskContext.get().partitionId(), encoder(tokenizer, chunks), np.zeros(room + 1, np.int64), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                out: list[tuple] = []
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"]):
                    ids = coder.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    first = n if n <= room else n % room or room
                    start, piece = 0, 0
                    while start < n:
                        stop = first if not start else start + room
                        these = ids[4 * start : 4 * stop]
                        out.append((doc_id, (part << 40) + doc, piece, start, stop - start, zlib.crc32(these), part, int(seen[stop - start])) + ((these,) if keep_ids else ()))
                        seen[stop - start] += 1
                        start, piece = stop, piece + 1
                    doc += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    assert names == arrow.names
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidied(cut), schema)


def plan_patterns(counts: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """counts[l]: pieces of length l. Returns (lengths that share a sequence, how many times).

    Exact fills are good as such, but they may use up the short pieces that others need. So they
    are planned for the longest pieces only, down to several lengths, with up to one, two or three
    lengths in a gap, and the plan with fewest sequences counts; the deepest of equals.
    """
    plans = [(_plan(counts, room, depth, down), -depth) for depth in (3, 2, 1) for down in (1, room // 2, room * 3 // 4, room * 7 // 8, room)]
    return min(plans, key=lambda p: (sum(times for _, times in p[0]), p[1]))[0]


def _plan(counts: np.ndarray, room: int, depth: int, down: int) -> list[tuple[tuple[int, ...], int]]:
    """From the longest length down to `down`, each takes single lengths, pairs and triples (up to
    `depth` lengths) that fill its gap exactly, as often as their counts allow. What is left is
    packed best fit, longest first, with equal sequences handled together."""
    left, patterns = counts.astype(np.int64).copy(), []

    def use(lengths: tuple[int, ...]) -> None:
        times = min(left[x] // lengths.count(x) for x in set(lengths))
        for x in lengths:
            left[x] -= times
        patterns.append((lengths, int(times)))

    def enough(lengths: tuple[int, ...]) -> bool:
        return all(left[x] >= lengths.count(x) for x in set(lengths))

    def pair(total: int, at_most: int, also: tuple[int, ...]) -> tuple[int, int] | None:
        """The pair of that sum with the longest member; also: what goes with it."""
        longer = np.arange(min(at_most, total - 1), (total - 1) // 2, -1)
        for x in longer[(left[longer] > 0) & (left[total - longer] > 0)]:
            if enough((*also, int(x), total - int(x))):
                return int(x), total - int(x)
        return None

    if left[room]:
        use((room,))
    for length in range(room - 1, down - 1, -1):
        gap, dry = room - length, False
        while left[length] and not dry:
            if gap <= length and enough((length, gap)):
                use((length, gap))
            elif depth > 1 and (two := pair(gap, length, (length,))):
                use((length, *two))
            elif depth < 3:
                dry = True
            else:
                dry = True
                for x in np.nonzero(left[: min(length, gap - 2) + 1])[0][::-1]:
                    if two := pair(gap - int(x), int(x), (length, int(x))):
                        use((length, int(x), *two))
                        dry = False
                        break
    opened: dict[int, list[list]] = {}  # gap -> [lengths, times]
    for length in range(room, 0, -1):
        need = int(left[length])
        while need:
            gap = min((g for g in opened if g >= length), default=None)
            if gap is None:
                fit = room // length
                times, rest = divmod(need, fit)
                for lengths, n in (((length,) * fit, times), ((length,) * rest, 1 if rest else 0)):
                    if n:
                        opened.setdefault(room - sum(lengths), []).append([lengths, n])
                break
            lengths, times = opened[gap].pop()
            used = min(times, need)
            if times > used:
                opened[gap].append([lengths, times - used])
            if not opened[gap]:
                del opened[gap]
            opened.setdefault(gap - length, []).append([(*lengths, length), used])
            need -= used
    return patterns + [(lengths, times) for group in opened.values() for lengths, times in group]


def places(patterns: list[tuple[tuple[int, ...], int]], room: int) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first ranks, sequence of that rank, offset): ranks from one first rank to the
    next go to consecutive sequences at one offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = [0] * (room + 1), 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            found.setdefault(x, []).append((taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*spans)) for x, spans in found.items()}


def pack(pieces: DataFrame, room: int, scratch: Scratch) -> DataFrame:
    """Adds sequence_id and offset to the rows of token_pieces."""
    pieces = scratch.put(pieces, "pieces")
    counts = scratch.put(pieces.groupBy("part", "length").count(), "counts")
    histogram = np.zeros(room + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # `room` rows at most
        histogram[length] = n
    at = places(plan_patterns(histogram, room), room)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")).hint("merge")
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length):
                mine = np.nonzero(length == x)[0]
                first, starts, offsets = at[int(x)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = starts[k] + rank[mine] - first[k], offsets[k]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch[n] for n in kept] + [pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), ", ".join([*columns, "sequence_id long", "offset long"]))


def op6_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, 1024, 2), 1024, Scratch(spark, "op6")).drop("doc")
