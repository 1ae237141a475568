"""HTML text, WARC archives, language model scores, packing and weak labels."""

import gzip
import hashlib
import io
import math
import random
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from pyarrow import fs

from vellum.llm import html_text, warc, weak_quality
from vellum.llm.common import Scratch
from vellum.llm.hmm_score import END, Hmm, HmmModel, Settings, _pieces, held_out, tokens
from vellum.llm.packing import ChunkEncoder, encoder, pack, plan_patterns, token_pieces


# HTML ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("a<b", "a<b"),
        ("<p>x &amp; y&lt;z &#65;&nbsp;b &unknown; &amp</p>", "x & y<z A b &unknown; &"),
        ("<article><h1>T</h1><p>a <b>b</b>c<br>d<p>e</article>out", "T\na bc d\ne"),
        ("<nav>n</nav><header><h1>Site</h1></header><main><header><h1>T</h1></header>x<aside>s</aside>y</main><footer>f</footer>", "T\nx\ny"),
        ("<article><p>t<section class='post-comments'><p>no</section><form><p>no</form><p>u</article>", "t\nu"),
        ("<script>var t='</p>';</script><style>p{}</style><p title='a>b'>x</p><!-- c <p>d</p> -->", "x"),
        ("<div class='ad'>no</div><div id='cookie-banner'>no</div><div role='navigation'>no</div><div hidden>no</div><div>yes</div>", "yes"),
        ("<article><p>q</p><div class='ad'>no</div> <ul><li>one<li>two</ul></article>", "q\none\ntwo"),
        ("<p>unclosed <i>x", "unclosed x"),
        ("<script>never closed", ""),
        ("<p title='x>y</p><p>z</p>", "y\nz"),
    ],
)
def test_page(page, want):
    assert alone(page) == want


def alone(page):
    """Text of a page on a host without repeats."""
    blocks = html_text.page_blocks(page)
    return html_text.main_text([z for z, _ in blocks], [t for _, t in blocks], np.empty(0, np.uint64), np.uint64(0), 12)[0]


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<a \"'" * 200_000, '<a "> "' * 100_000 + '"', "<div>" * 5_000 + "</span></p>" * 80_000, "<div>" + "<b>" * 50_000 + "<p></p>" * 50_000, "<script>" + "</script " * 100_000, "<!--" * 200_000, "<" * 500_000, "<ul>" + "<li>" * 100_000],
    ids=range(9),
)
def test_long_pages_take_time_by_their_length(page):
    began = time.process_time()
    assert alone("<p>kept</p>" + page).startswith("kept")
    long = time.process_time() - began
    began = time.process_time()
    alone("<p>kept</p>" + page[: len(page) // 4])
    assert long < 2 or long < 12 * (time.process_time() - began)


def test_one_long_word_and_text():
    assert alone("<p>" + "x" * 3_000_000 + "</p>") == "x" * 3_000_000
    assert len(alone("<p>" + "ab &amp; " * 200_000 + "</p>")) == 5 * 200_000 - 1


@pytest.mark.parametrize(
    "page, want",
    [
        ("<main>t</main><article class='comment'>reader says</article>", "t"),
        ("<article>main</article><section><article class='related teaser'>card</article></section>", "main"),
        ("<article class='post has-comments'>main<article class='comment-item'>no</article></article>", "main"),
        ("<article><p class='notice-period'>a</p><p class='social-history'>b</p><p class='commentary'>c</p></article>", "a\nb\nc"),
        ("<article>t<div class='shareButtons'>no</div><div class='related-posts'>no</div><div class='comment-list'>no</div><div id='ad-slot-2'>no</div></article>", "t"),
    ],
)
def test_hints_inside_articles(page, want):
    assert alone(page) == want


def brute_texts(rows, run):
    """Texts by looking every run up on every different page of the host."""
    pages = {}
    for i, host, html in rows:
        blocks = html_text.page_blocks(html)
        pages[i] = host, blocks, [w for _, t in blocks for w in t.split()]
    out = {}
    for i, (host, blocks, words) in pages.items():
        others = {tuple(b): w for h, b, w in pages.values() if h == host}.values()
        mask = [False] * len(words)
        for a in range(len(words) - run + 1):
            if sum(any(w[x : x + run] == words[a : a + run] for x in range(len(w))) for w in others) >= html_text.needed(len(others)):
                mask[a : a + run] = [True] * run
        at, lines, marked = 0, [], any(z for z, _ in blocks)
        for zone, text in blocks:
            block = text.split()
            kept = [w for w, m in zip(block, mask[at:]) if not m]
            at += len(block)
            if zone == html_text.CONTENT:
                lines.append(text)
            elif kept and (zone or not marked):
                lines.append(" ".join(kept))
        out[i] = "\n".join(lines), sum(mask)
    return out


def test_runs_of_a_host(spark):
    """Against brute force, the same for any partitions and any limits of the exchange; without
    the suffixes nothing would be cut."""
    rng = random.Random(2)
    runs = [" ".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(12)]

    def page():
        blocks = [rng.choice(runs) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 15))) for _ in range(rng.randrange(0, 6))]
        marked = rng.random() < 0.3
        html = "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<p class='notice-period'>{b}</p>" if marked else f"<div>{b}" for b in blocks)
        return f"<article>{html}</article><p>{rng.choice(runs)}</p>" if marked else html

    rows = [(i, rng.choice("aab"), page()) for i in range(120)]
    rows += [(i + 120, *rng.choice(rows)[1:]) for i in range(40)]
    want = brute_texts(rows, 4)
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, h, x in rows], "page_id long, url string, html string")
    for limits, parts in (({}, 4), ({"held": 40, "at_once": 7}, 7), ({"held": 40, "at_once": 7, "small": 0, "keys": 0}, 3)):
        got = {r.page_id: (r.text, r.repeated_tokens) for r in html_text.extract_text(df.repartition(parts), Scratch(spark, "t"), 4, **limits).collect()}
        assert got == want
    assert sum(n > 0 for _, n in want.values()) > 50


def test_boilerplate(spark):
    shared, article = " ".join(f"s{i}" for i in range(20)), " ".join(f"a{i}" for i in range(30))
    rows = [(i, "http://h.example/x", f"<div>{shared}</div><div>own{i} {' '.join(f'w{i}x{j}' for j in range(15))} {shared}</div>") for i in range(6)]
    rows += [(10, "http://other.example/", f"<div>{shared}</div>"), (11, None, f"<p>{shared}</p>"), (12, "http://h.example/", f"<article>{article}</article><p>{shared}</p>"), (13, "http://h.example/", f"<article>{article}</article>"), (None, "http://h.example/", None), (13, "http://h.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS group", "3 AS text")
    got = {}
    for r in html_text.extract_text(df, Scratch(spark, "t"), 12).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[0] == ["own0 " + " ".join(f"w0x{j}" for j in range(15))]
    assert got[10] == [shared] and got[11] == [shared]  # hosts of their own
    assert got[12] == [article] and sorted(got[13]) == ["", article] and got[None] == [""]  # an article stays whole
    assert html_text.extract_text(df.limit(0), Scratch(spark, "t")).count() == 0


def test_copies_and_quotes_stay(spark):
    """Copies of an unmarked page, and a passage that two pages quote, are no boilerplate."""
    quote, menu = " ".join(f"q{i}" for i in range(20)), " ".join(f"m{i}" for i in range(20))
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(15))
    rows = [(i, "http://h/", f"<p>{menu}</p><p>{own(0)}</p>") for i in range(5)]
    rows += [(i, "http://h/", f"<p>{menu}</p><p>{own(i)}</p>" + f"<p>{quote}</p>" * (i < 7)) for i in range(5, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_text(df, Scratch(spark, "t"), 12).collect()}
    assert [got[i].text for i in range(9)] == [own(0)] * 5 + [f"{own(i)}\n{quote}" for i in (5, 6)] + [own(7), own(8)]
    assert all(got[i].repeated_tokens == 20 for i in range(9))


# WARC ------------------------------------------------------------------------------------

PAGES = [(3, "http://a", "same"), (1, "http://b", "same"), (None, None, None), (5, "u\r\n%0Ax", ""), (5, "u", ""), (7, "c", "grün \r\n\r\n x"), (8, "d", "WARC/1.1\r\n\r\n" * 50), (3, "http://a", "same")]


def test_warc_round_trip(spark):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS sha", "3 AS to_row")
    index = scratch.put(warc.write_archives(warc.mark_revisits(df, scratch), scratch.path("w")), "index")
    got = warc.read_records(index, scratch.path("w")).collect()
    assert len(got) == len(PAGES)
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(p), str(u)) for p, u, _ in PAGES)
    responses = [r for r in got if r.record_type == "response"]
    assert sorted(bytes(r.payload).decode() for r in responses) == sorted({h or "" for _, _, h in PAGES})
    assert {r.payload_digest: r.page_id for r in responses}[warc.payload_digest(b"same")] == 1
    assert all(r.refers_to in (1, 5) for r in got if r.record_type == "revisit")
    store, root = fs.FileSystem.from_uri(scratch.path("w"))
    for f in {r.file for r in index.collect()}:  # whole archives are streams of records, too
        data = gzip.GzipFile(fileobj=io.BytesIO(store.open_input_file(f"{root}/{f}").read())).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    some = warc.read_records(index.where("page_id = 7"), scratch.path("w")).collect()
    assert [bytes(r.payload).decode() for r in some] == ["grün \r\n\r\n x"]
    empty = scratch.put(warc.write_archives(warc.mark_revisits(df.limit(0), scratch), scratch.path("e")), "index")
    assert warc.read_records(empty, scratch.path("e")).count() == 0


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "x" * 9), (4, "d", "x" * 9)], "page_id long, url string, html string")
    marked = {r.page_id: r.to_page for r in warc.mark_revisits(df, Scratch(spark, "t"), least=5).collect()}
    assert marked == {1: None, 2: None, 3: None, 4: 3}


def test_ranges():
    spans = [(0, 10), (10, 5), (warc.GAP + 15, 7), (2 * warc.GAP + 23, 1), (9 * warc.BLOCK, warc.BLOCK * 2)]
    got = list(warc.ranges(spans))
    assert got == [(0, warc.GAP + 22, [0, 1, 2]), (2 * warc.GAP + 23, 2 * warc.GAP + 24, [3]), (9 * warc.BLOCK, 11 * warc.BLOCK, [4])]


# language model --------------------------------------------------------------------------


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    m = Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    flat, lengths = rng.integers(0, 5, 14), np.array([4, 1, 6, 3])
    starts = np.cumsum(lengths) - lengths
    got = m.forward(flat, starts, lengths)
    start, move, emit = (np.zeros_like(x) for x in (m.start, m.move, m.emit))
    for s, n, g in zip(starts, lengths, got):
        seq, total = flat[s : s + n], 0.0
        paths = {}
        for path in product(range(3), repeat=int(n)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for t in range(1, n):
                p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
            paths[path] = p
            total += p
        assert math.isclose(g, math.log(total), rel_tol=1e-12)
        for path, p in paths.items():
            start[path[0]] += p / total
            for t in range(n):
                emit[seq[t], path[t]] += p / total
                if t:
                    move[path[t - 1], path[t]] += p / total
    e = m.expected(flat, starts, lengths)
    assert all(np.allclose(x, y, rtol=1e-4, atol=1e-5) for x, y in zip(e, (start, move, emit)))  # single precision


def test_pieces_cover_everything():
    starts, lengths = np.array([0, 10, 11]), np.array([10, 1, 7])
    seen = Counter(t for s, n in _pieces(starts, lengths, 4, 6) for a, k in zip(s, n) for t in range(a, a + k))
    assert seen == Counter(range(18))


def language(seed, n):
    """Two kinds of text with words of their own, so that states tell something."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"{'ab'[i % 2]}{int(rng.paretovariate(1)) % 300}" for _ in range(rng.randrange(0, 60))]
        out.append((i, " ".join(words)))
    return out


def test_scores(spark):
    rows = language(1, 400) + [(1000, None), (1001, ""), (1002, "zz\tZZ\x0bqq"), (None, "a1 a2"), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS word")
    settings = Settings(states=4, head=2.2, classes=0.16, slices=3, rounds=2)
    model = HmmModel(df, Scratch(spark, "t"), settings)
    got = model.scores().collect()
    assert len(got) == len(rows)
    c = Counter(t for i, x in rows if not held_out(i) for t in [*tokens(x), END])
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    for r in got:
        seq = [*tokens(text[r.doc_id]), END]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(seq), n, sum(c[t] > 0 for t in seq)) and r.held_out == held_out(r.doc_id)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in seq), rel_tol=1e-9)
    out = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # every word's share of its class, and the classes' and head's of a state, come to one
    assert np.allclose(model.model.emit.sum(axis=0), 1) and np.allclose(model.model.move.sum(axis=1), 1)
    assert model.classes > 1
    for k in range(model.classes):
        own = [w for w in c if w != END and w not in model.symbols.ids and zlib.crc32(w) % model.classes == k]
        total = sum((c[w] + 0.1) / (model.class_n[k] + 0.1 * (model.class_v[k] + 1)) for w in own) + 0.1 / (model.class_n[k] + 0.1 * (model.class_v[k] + 1))
        assert math.isclose(total, 1, rel_tol=1e-9)
    assert HmmModel(df.limit(0), Scratch(spark, "t"), settings).scores().count() == 0


def test_states_come_from_all_documents(spark):
    """The model is that of a loop over the slices, then over all training documents."""
    rows = language(2, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    settings = Settings(states=3, head=2.2, classes=0.16, slices=2, rounds=2, passes=4)
    model = HmmModel(df, Scratch(spark, "t"), settings)
    coded = {i: model.symbols.of(tokens(x))[0] for i, x in rows if not held_out(i)}
    dealt = {r.doc_id: r.slice for r in model.documents.where("not held_out").collect()}
    assert dealt.keys() == coded.keys() and set(dealt.values()) == {0, 1}

    def expected(hmm, some):
        lengths = np.array([len(c) for c in some], np.int64)
        return hmm.expected(np.concatenate(some), np.cumsum(lengths) - lengths, lengths)

    want, held = Hmm.fresh(3, model.unigrams, settings.seed), None
    for step, k in enumerate([0, 1, 0, 1]):
        some = [c for i, c in coded.items() if dealt[i] == k]
        counts = [x * (model.n / sum(map(len, some))) for x in expected(want, some)]
        share = (step + 1) ** -settings.decay
        held = counts if held is None else [(1 - share) * old + share * new for old, new in zip(held, counts)]
        want = Hmm.from_counts(*held, model.unigrams)
    for _ in model.likelihoods:
        want = Hmm.from_counts(*expected(want, list(coded.values())), model.unigrams)
    assert np.allclose(model.model.emit, want.emit, rtol=1e-3) and np.allclose(model.model.move, want.move, rtol=1e-3)
    assert 2 <= len(model.likelihoods) <= 4 and all(b > a for a, b in zip(model.likelihoods, model.likelihoods[1:]))


def test_model_grows_with_the_vocabulary(spark):
    sizes = []
    for n in (100, 400):
        df = spark.createDataFrame([(i, " ".join(f"w{i * 7 + j}" for j in range(7))) for i in range(n)], "doc_id long, text string")
        model = HmmModel(df, Scratch(spark, "t"), Settings(states=2, head=2.0, classes=0.5, passes=1))
        sizes.append((len(model.symbols.ids), model.classes))
    assert sizes[1][1] > 1.5 * sizes[0][1]


# packing ---------------------------------------------------------------------------------


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for room in (8, 33, 100):
        for _ in range(8):
            counts = rng.poisson(rng.choice([0.3, 2, 40]), room + 1) * (rng.random(room + 1) < 0.6)
            counts[0] = 0
            patterns = plan_patterns(counts, room)
            used = np.zeros(room + 1, np.int64)
            for lengths, times in patterns:
                assert sum(lengths) <= room and times > 0
                for x in lengths:
                    used[x] += times
            assert (used == counts).all()
            tokens_, bins = (counts * np.arange(room + 1)).sum(), sum(t for _, t in patterns)
            assert bins <= 2 * math.ceil(tokens_ / room) + 1


def test_exact_complements():
    counts = np.zeros(101, np.int64)
    for x, n in ((70, 4), (30, 2), (20, 1), (10, 3), (5, 2), (100, 1)):
        counts[x] = n
    assert sum(t for _, t in plan_patterns(counts, 100)) == 5  # 70+30 twice, 70+20+10, 70+10+10+5+5, 100


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", "Wörter", "x1", "a,b"]) for _ in range(rng.choice([0, 3, 40, 300])))) for i in range(300)] + [(1, None), (1, None), (None, "  odd \t space\n\n "), (5, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length", "3 AS rank").repartition(5)
    got = pack(token_pieces(df, 256, 2, keep_ids=True), 256, Scratch(spark, "t")).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length <= 256
        by_doc.setdefault(r.doc, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_doc) == len(rows)
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 256 for r in parts[1:])
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
    whole = Counter((rs[0].doc_id, b"".join(bytes(r.ids) for r in rs)) for rs in by_doc.values())
    coder = encoder(None)
    want = Counter((i, np.array(coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    assert whole == want
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 256
    assert len(by_sequence) <= 1.1 * sum(r.length for r in got) / 256 + 2
    assert pack(token_pieces(df.limit(0), 256, 2), 256, Scratch(spark, "t")).count() == 0


def test_encoder_is_the_tokenizer():
    import public_tokenizers

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, fresh, rng = ChunkEncoder(path, remembered=50), Tokenizer.from_file(path), random.Random(1)
    assert fresh.encode("hello <|endoftext|> world", add_special_tokens=False).ids == np.frombuffer(coder.encode("hello <|endoftext|> world"), "<u4").tolist()
    parts = ["a", "b'", "'s", " ", "  ", "\n", "\t", ".", "!?", "é", "1", "²", "日本", " ", "​", "|", "%", " x", "\x1c", "🙂", "A", "ß", "'ll", "-", "\r\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert coder.encode(text) == np.array(fresh.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# weak labels -----------------------------------------------------------------------------


def test_em_finds_who_is_right():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.25
    accuracy, patterns = [0.95, 0.8, 0.6], Counter()
    for y in truth:
        votes = [(2 if y else 1) if rng.random() < a else (1 if y else 2) for a in accuracy]
        patterns[(*(v if rng.random() < 0.8 else 0 for v in votes), 0)] += 1
    post, table = weak_quality.em(patterns, 4, 0.2, 0.99, False)
    got = [(table[j, 0, 1] + table[j, 1, 2]) / 2 for j in range(3)]
    assert got[0] > got[1] > got[2] and abs(got[0] - 0.95) < 0.08
    assert post[2, 2, 2, 0] > 0.9 and post[1, 1, 1, 0] < 0.1


@pytest.mark.parametrize("silence", [True, False])
def test_em_on_patterns_is_em_on_texts(silence):
    """Against plain loops over texts, a vote at a time."""
    rng = random.Random(6)
    texts = [tuple(rng.choice([0, 0, 1, 2] if rng.random() < 0.7 else [2]) for _ in range(3)) for _ in range(200)]
    believed, prior, trust = [[0.4, 0.55, 0.05], [0.4, 0.05, 0.55]], 0.1, 0.9
    p = [[list(row) for row in believed] for _ in range(2)] + [[[0.5, trust / 2, (1 - trust) / 2], [0.5, (1 - trust) / 2, trust / 2]]]
    if not silence:
        for j, y in product(range(3), range(2)):
            p[j][y][0] = 1.0
    bad = prior
    for _ in range(60):
        post = []
        for votes in texts:
            likely = [math.prod(p[j][y][v] for j, v in enumerate(votes)) for y in range(2)]
            post.append(bad * likely[1] / (bad * likely[1] + (1 - bad) * likely[0]))
        bad = (sum(post) + 10 * prior) / (len(texts) + 10)
        for j, y in product(range(2), range(2)):
            mass = [sum(w if y else 1 - w for votes, w in zip(texts, post) if votes[j] == v) + 10 * believed[y][v] for v in range(3)]
            p[j][y] = [m / sum(mass if silence else mass[1:]) for m in mass]
            if not silence:
                p[j][y][0] = 1.0
    got, _ = weak_quality.em(Counter(texts), 3, prior, trust, silence)
    assert all(math.isclose(got[votes], w, rel_tol=1e-6, abs_tol=1e-9) for votes, w in zip(texts, post))


def test_long_texts_that_loop_are_junk():
    rng = random.Random(7)
    vote = lambda words: weak_quality.quality_votes(weak_quality._shares(" ".join(words)))[4]
    line = [f"w{i}" for i in range(150)]
    assert vote(line * 100) == vote(line * 10) == weak_quality.BAD
    assert vote([f"w{rng.randrange(3000)}" for _ in range(60_000)]) == weak_quality.ABSTAIN


def labelled(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}{rng.choice('abc')}" for _ in range(rng.randrange(30, 120))]
        kind = rng.random()
        if kind < 0.1:
            words = [w + "###" for w in words]
        elif kind < 0.15:
            words = [w for w in words[:15] for _ in range(8)]
        elif kind < 0.25:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron"]))
        elif kind < 0.33:
            words.insert(rng.randrange(len(words)), "zorgs" + rng.choice(["ta", "be", "lo"]))
        rows.append((i, " ".join(words), "en" if kind < 0.25 else "xx"))
        if i % 2 == 0:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.33)))
        rows[-1] = (*rows[-1], kind < 0.15, 0.15 <= kind < 0.33)
    return rows, labels


def test_features_of_a_text_with_and_without_a_mask():
    words, shares = ["votes", "upper", "é", "votes"], weak_quality._shares("votes upper é votes")
    every = weak_quality.Features(20).of(words, shares, [2, 0])
    number = lambda part: xxhash.xxh32_intdigest(part.encode()) & (1 << 20) - 1
    shape = [f"{k}={min(12, int(shares[k] * 40))},1" for k in ("symbols", "bars", "upper", "top", "repeats")] + ["vote 0=2", "vote 1=0"]
    assert every.tolist() == sorted({number(p) for p in ["votes", "^vote", "^votes", "upper", "^uppe", "^upper", "é", *shape]})
    live = np.zeros(1 << 20, bool)
    live[[number("^uppe"), number("^vote"), number("vote 0=2")]] = True
    assert weak_quality.Features(20, live).of(["é"], shares, [2, 0]).tolist() == [number("vote 0=2")]  # shapes have no word beginnings
    assert weak_quality.Features(20, live).of(words, shares, [2, 0]).tolist() == sorted(map(number, ("^uppe", "^vote", "vote 0=2")))


def test_quality(spark):
    rows, labels = labelled(1500, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, low boolean, toxic boolean").selectExpr("*", "1 AS quality", "'x' AS features", "'y' AS whole_text")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [r for r in weak_quality.QualityModel(df, marks, Scratch(spark, "t")).scored(df).collect() if r.doc_id % 2]
    assert sum((r.p_low >= 0.5) == r.low for r in got) > 0.98 * len(got)
    assert sum((r.p_toxic >= 0.5) == r.toxic for r in got) > 0.98 * len(got)
    df = df.selectExpr("*", "'z' AS P_low", "2 AS p_toxic")
    kept = weak_quality.accepted_documents(df, marks, Scratch(spark, "t"))
    assert kept.columns == df.columns and not any(r.low for r in kept.where("low").collect()[3:])


def test_quality_edge_cases(spark):
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame([(None, None, None), (1, "", "en"), (1, "", "en"), (2, "x " * 60_000, None), (3, "fine words here", "en")], schema)
    marks = spark.createDataFrame([(1, None, 1), (1, 0, None), (None, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for some, told in ((df, marks), (df, marks.limit(0)), (df.limit(0), marks)):
        assert weak_quality.QualityModel(some, told, Scratch(spark, "t")).scored(some).count() == some.count()
    got = weak_quality.accepted_documents(df, marks, Scratch(spark, "t")).collect()
    assert {r.doc_id for r in got} >= {None, 1, 3}


def test_digest_is_bare_base32():
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39a3")
