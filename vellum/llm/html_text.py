"""Main text of HTML pages: markup zones, and the sorted suffixes of each host's pages.

A page becomes blocks of text, each in a zone: chrome (menus, headers, footers, adverts, forms,
comments ...), content (inside the element that holds the article), suspect (content whose class
sounds like chrome), or plain. The token streams of all pages of a host are one array of suffixes,
of which the first `run` tokens count, cut at the page's end. Spark sorts them, by a hash of these
tokens: equal ones come together, wherever their pages are. Runs of at least `run` tokens that
enough different pages have are boilerplate; copies of a page count once, and a passage that two
articles quote stays. Plain and suspect blocks lose their boilerplate and keep their unique runs;
plain ones count only in pages that don't mark an article. What a page marks as its article may
well be repeated elsewhere, and stays.

Pages are parsed once. What is exchanged are the suffixes' hashes, added up within each task, and
sorted, so that their differences are short; the texts stay where they are.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, remembered, table, text_or_empty
from .near_dedup import WordHashes, _grouped, _mix

PLAIN, CONTENT, SUSPECT = 0, 1, 2
#: Rows of a number and a few bytes, or keys of runs, that may be broadcast; more are joined by a shuffle.
SMALL, KEYS = 250_000, 2_000_000
#: A run is cut if so many different pages of its host have it, and this share of them.
LEAST, SHARE = 3, 0.01
#: Bits of a suffix's hash on a host of one page; more with its pages. A token that isn't
#: boilerplate looks so about once in a thousand million.
BITS = 32
#: Suffixes that a task holds; pages of a host for each bucket of its hashes, or group that meets its runs.
HELD, PAGES = 2_000_000, 1_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")  # with a quote that never ends
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("script style noscript template nav footer aside form button select option textarea input label iframe object embed svg canvas head title menu dialog audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class names and ids that mark chrome; those in STEMS also as beginnings.
HINTS = frozenset("ad ads adv nav navbar topbar toolbar masthead share sharing social related login signup signin search notice notices notification alert widget rail legal copyright gdpr respond reply skip tags".split())
STEMS = ("advert", "sponsor", "comment", "breadcrumb", "cookie", "consent", "newsletter", "subscri", "promo", "sidebar", "navig", "footer", "menu", "disqus", "pagin", "popup", "modal", "banner")
#: Parts that say that a hint before or after them names a part of the page, not a topic.
HOLDERS = frozenset("area bar block box button buttons card container content form icons inner item items label link links list module outer panel post posts row section slot stories story title unit wrap wrapper".split())
#: Class names of article elements that aren't the page's article, and beginnings of such.
ASIDES = frozenset("comment comments reply replies teaser teasers related recommended promo sponsored advert card".split())
ARTICLES = frozenset("article content entry post story body text main page".split())


def _is_chrome(tag: str, attributes: dict[str, str], in_content: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_content:
        return True
    if "hidden" in attributes or attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    names = (attributes.get("class", "") + " " + attributes.get("id", "")).split()
    if tag == "article":
        return any(re.split("[-_]", n.lower())[0] in ASIDES for n in names)
    if tag in ("body", "html", "main"):
        return False
    if in_content:
        return any(_hint(n) == 2 for n in names)
    return any(map(_hint, names)) or any("header" in (parts := _parts(n)) and not ARTICLES & set(parts) for n in names)


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(name)]


def _hint(name: str) -> int:
    """Whether a class name or id names chrome: 2 surely, 1 perhaps, 0 no."""
    parts = _parts(name)
    told = [p in HINTS or p.startswith(STEMS) and not p.startswith("commentar") for p in parts]
    if not any(told):
        return 0
    return 2 if all(t or p in HOLDERS or p.isdigit() for t, p in zip(told, parts)) else 1


def _is_content(tag: str, attributes: dict[str, str]) -> bool:
    return tag in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "") == "articleBody"


def _tags(page: str) -> Iterator[tuple[str | None, str, str, int]]:
    """(text, "", "", end), or (None, name or /name, attributes, end) of each tag, in time that
    grows with the page. A sent value is the place to go on from. Quotes that never end aren't
    quotes, nor are any that follow; a < without a > is text."""
    at, strict, last = 0, True, page.rfind(">")
    while at < len(page):
        to = page.find("<", at)
        if to != at:
            to = len(page) if to < 0 else to
            goto = yield page[at:to], "", "", to
        elif page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            at = len(page) if to < 0 else to + 3
            continue
        elif page.startswith(("<!", "<?"), at) and len(page) > at + 2:
            to = page.find(">", at)
            at = len(page) if to < 0 else to + 1
            continue
        else:
            match = None
            if at < last:
                match = strict and _TAG.match(page, at)
                if not match:
                    match = _LOOSE.match(page, at)
                    strict = strict and not match
            if match:
                to = match.end()
                goto = yield None, match[1] + match[2].lower(), match[3], to
            else:
                to = at + 1
                goto = yield "<", "", "", to
        at = to if goto is None else goto


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks that aren't chrome, in page order. References are decoded, and
    white space inside a block is one space. Elements left open end with their parents."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    # of each open element: name, chrome, zone, place of the block that holds it; how many are open by name
    stack: list[tuple[str, bool, int, int]] = []
    opened: Counter = Counter()
    chrome, zone = False, PLAIN
    page = page or ""

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((zone, text))
        held.clear()

    def close(to: int) -> None:
        nonlocal chrome, zone
        while len(stack) > to:
            opened[stack.pop()[0]] -= 1
        now = stack[-1][1:3] if stack else (False, PLAIN)
        if now[1] != zone:
            flush()
        chrome, zone = now

    tags = _tags(page)
    goto = None
    while True:
        try:
            text, name, attributes, at = tags.send(goto)
        except StopIteration:
            break
        goto = None
        if text is not None:
            if not chrome:
                held.append(html.unescape(text))
            continue
        closing, name = name.startswith("/"), name.lstrip("/")
        if name in BLOCK:
            flush()
        elif name == "br":
            held.append(" ")
        if closing:
            if opened[name] > 0:
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                close(to)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            to = page.find(">", end.end()) if end else -1
            goto = len(page) if to < 0 else to + 1
            continue
        if name in VOID:
            continue
        holder = stack[-1][3] if stack else -1
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and holder >= 0 and stack[holder][0] == name:
            close(holder)  # one of these ends an open one of its kind
            holder = stack[-1][3] if stack else -1
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        was = zone
        chrome = chrome or _is_chrome(name, found, zone != PLAIN)
        if not chrome and zone == PLAIN and _is_content(name, found):
            was = CONTENT
        elif not chrome and zone == CONTENT and any(_hint(n) for k in ("class", "id") for n in found.get(k, "").split()) and name != "article":
            was = SUSPECT
        if was != zone:
            flush()
            zone = was
        opened[name] += 1
        stack.append((name, chrome, zone, len(stack) if name in BLOCK else holder))
    flush()
    return out


def suffixes(words: list[str], run: int) -> np.ndarray:
    """A hash of the first `run` tokens of each suffix that has so many."""
    n = len(words) - run + 1
    if n < 1:
        return np.empty(0, np.uint64)
    hashes = remembered("words", WordHashes)
    w = np.fromiter((hashes[x.encode("utf-8", "surrogatepass")] for x in words), np.uint64, len(words))
    factors = _mix(np.arange(1, run + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for i in range(run):
        total += w[i : n + i] * factors[i]
    return _mix(total)


def covered(n: int, hits: np.ndarray, run: int) -> np.ndarray:
    """Mask of the n tokens inside the runs that start at hits."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, hits, 1)
    np.add.at(change, hits + run, -1)
    return np.cumsum(change[:-1]) > 0


def needed(pages: int) -> int:
    """Different pages of a host of so many that must have a run before it is cut."""
    return max(LEAST, math.ceil(SHARE * pages))


def shift(pages: int) -> np.uint64:
    """Bits of a hash that don't count on a host of so many different pages."""
    return np.uint64(max(0, 64 - BITS - pages.bit_length()))


def main_text(zones: list[int], texts: list[str], boilerplate: np.ndarray, dropped: np.uint64, run: int) -> tuple[str, int]:
    """Text of one page, and number of its tokens that are boilerplate. boilerplate: sorted
    hashes of the host's runs, without the bits that are dropped."""
    if not len(boilerplate):
        marked = any(z != PLAIN for z in zones)
        return "\n".join(t for z, t in zip(zones, texts) if z != PLAIN or not marked), 0
    blocks = [t.split(" ") for t in texts]
    words = [w for b in blocks for w in b]
    keys = suffixes(words, run) >> dropped
    place = np.minimum(np.searchsorted(boilerplate, keys), len(boilerplate) - 1)
    mask = covered(len(words), np.nonzero(boilerplate[place] == keys)[0], run)
    marked, lines, at = any(z != PLAIN for z in zones), [], 0
    for zone, text, block in zip(zones, texts, blocks):
        cut = mask[at : at + len(block)]
        at += len(block)
        if zone == CONTENT or (zone == SUSPECT or not marked) and not cut.any():
            lines.append(text)
        elif (zone == SUSPECT or not marked) and not cut.all():
            lines.append(" ".join(w for w, c in zip(block, cut) if not c))
    return "\n".join(lines), int(mask.sum())


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def _blocks(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host, zones, texts, digest of each page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                found = [page_blocks(p.as_py()) for p in rows["html"]]
                zones = pa.array([[z for z, _ in f] for f in found], pa.list_(pa.int8()))
                texts = pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))
                digests = pa.array([xxhash.xxh3_128_digest("\n".join(f"{z}{t}" for z, t in f).encode("utf-8", "surrogatepass")) for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([rows[c] for c in ("row", "page_id", "url", "host")] + [zones, texts, digests], names=["row", "page_id", "url", "host", "zones", "texts", "digest"])

    host = F.lower(F.regexp_extract(text_or_empty("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(parse, "row long, page_id long, url string, host string, zones array<tinyint>, texts array<string>, digest binary")


def _boilerplate(blocks: DataFrame, run: int, held: int, pages: int) -> DataFrame:
    """host, n, keys of the runs that enough different pages have, in pieces. blocks: host, pages
    (how many different ones it has) and texts of different pages."""
    told = pa.schema([("host", pa.string()), ("bucket", pa.int32()), ("pages", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (host, n), parts in found.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                buckets = -(-n // pages)
                width = (1 << (64 - int(shift(n)))) // buckets + 1
                ends = np.searchsorted(keys, np.array([b * width for b in range(1, buckets)], np.uint64))
                rows = [(host, b, n, len(k), _packed(k), pa.compress(c.astype(np.int32).tobytes(), codec="zstd", asbytes=True)) for b, (k, c) in enumerate(zip(np.split(keys, ends), np.split(counts, ends))) if len(k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), told)], schema=told)
            found.clear()

        for batch in batches:
            for host, n, texts in zip(batch["host"].to_pylist(), batch["pages"].to_pylist(), batch["texts"]):
                if n < LEAST:
                    continue
                keys = np.unique(suffixes([w for t in texts.as_py() for w in t.split(" ")], run) >> shift(n))
                found.setdefault((host, n), []).append(keys)
                size += len(keys)
                if size > held:
                    yield from out()
                    size = 0
        yield from out()

    enough = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("n", pa.int32()), ("keys", pa.binary())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 2):
            every = np.concatenate([_unpacked(r[4], r[3]) for r in rows])
            counts = np.concatenate([np.frombuffer(pa.decompress(r[5], 4 * r[3], codec="zstd", asbytes=True), np.int32) for r in rows])
            keys, of = np.unique(every, return_inverse=True)
            keys = keys[np.bincount(of, counts) >= needed(rows[0][2])]
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((rows[0][0], rows[0][2], len(keys), _packed(keys)), enough)], schema=enough)

    parts = blocks.mapInArrow(tell, "host string, bucket int, pages long, n int, keys binary, counts binary")
    parts = parts.repartition("host", "bucket").sortWithinPartitions("host", "bucket")
    return parts.mapInArrow(meet, "host string, pages long, n int, keys binary")


def extract_text(pages: DataFrame, scratch: Scratch, run: int = 12, held: int = HELD, at_once: int = PAGES, small: int = SMALL, keys: int = KEYS) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_chars, repeated_tokens (those of the
    page's blocks that are boilerplate).

    The result depends on the pages alone: not on their order or partitions, nor on held (suffixes
    that a task holds), at_once (pages of a host that share a bucket of hashes), small and keys
    (what may be broadcast). A null url is a host of its own; null html and pages without text give
    an empty text. Rows are never merged; columns other than the three are not looked at.
    """
    blocks = scratch.put(_blocks(pages), "blocks")
    different = scratch.put(blocks.groupBy("host", "digest").agg(F.min("row").alias("row")), "different")
    hosts = scratch.put(different.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    copies = scratch.put(blocks.select("row").join(different.select("row"), "row", "left_anti"), "copies")
    sized = blocks.join(F.broadcast(hosts) if hosts.count() <= small else hosts.hint("merge"), "host")
    once = sized.join(F.broadcast(copies) if copies.count() <= small else copies.hint("merge"), "row", "left_anti")
    runs = scratch.put(_boilerplate(once.select("host", "pages", "texts"), run, held, at_once), "runs")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def texts(rows: list[tuple], boilerplate: np.ndarray, dropped: np.uint64) -> pa.RecordBatch:
        out = [(i, u, t, len(t), n) for i, u, zones, blocks in rows for t, n in [main_text(zones, blocks, boilerplate, dropped, run)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "url", "text", "n_chars", "repeated_tokens"])

    ddl = "page_id long, url string, text string, n_chars long, repeated_tokens long"
    if (runs.agg(F.sum("n")).first()[0] or 0) <= keys:
        known: dict[str, list] = {}
        for r in runs.collect():  # `keys` hashes of eight bytes at most, by count
            known.setdefault(r["host"], [r["pages"]]).append(_unpacked(r["keys"], r["n"]))
        shared = blocks.sparkSession.sparkContext.broadcast({h: (shift(n), np.sort(np.concatenate(k))) for h, (n, *k) in known.items()})

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = (np.uint64(0), np.empty(0, np.uint64))
            for batch in batches:
                for host, *row in zip(*(batch[c].to_pylist() for c in ("host", "page_id", "url", "zones", "texts"))):
                    dropped, boilerplate = shared.value.get(host, none)
                    yield texts([tuple(row)], boilerplate, dropped)

        return blocks.select("host", "page_id", "url", "zones", "texts").mapInArrow(clean, ddl)

    # the pages of a host with runs go to its runs, in groups
    groups = F.ceil(F.col("pages") / at_once)
    none = lambda kind: F.lit(None).cast(kind)
    heads = runs.select("host", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"), F.lit(0).alias("role"), "pages", "n", "keys", none("long").alias("page_id"), none("string").alias("url"), none("array<tinyint>").alias("zones"), none("array<string>").alias("texts"))
    rows = sized.select("host", F.pmod(F.xxhash64("row"), groups).alias("group"), F.lit(1).alias("role"), "pages", none("int").alias("n"), none("binary").alias("keys"), "page_id", "url", "zones", "texts")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, ready = None, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != now:
                    now, told, ready = row[:2], [], None
                if row[2] == 0:
                    told.append(_unpacked(row[5], row[4]))
                    continue
                if ready is None:
                    ready = np.sort(np.concatenate(told)) if told else np.empty(0, np.uint64)
                yield texts([row[6:]], ready, shift(row[3]))

    return heads.unionByName(rows).repartition("host", "group").sortWithinPartitions("host", "group", "role").mapInArrow(meet, ddl)


def op1_suffix_array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), Scratch(spark, "op1"))
