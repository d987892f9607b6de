"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import exact_dedup, html_text, lang_id, line_dedup, mixing, packing, similar, simhash, substring_dedup, token_counts, topk
from quillgraph.llm.components import connected_components
from quillgraph.llm.queries import vocabulary

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, body string, h long, `a.b` string"


def words(rng, n, alphabet="abcde"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage, base = words(rng, 70), words(rng, 120)
    rows = [None, "", "  \n\t ", "x", "x", "É!", words(rng, 4000), "a" * 1500, "ab" * 300 + "\n" + "ab" * 300, base, base + " z", base + " y"]
    for k in range(n - len(rows)):
        t = words(rng, rng.randint(1, 90))
        rows.append({0: t + "\n" + passage, 1: passage[: rng.randint(150, 260)] + t, 2: base.replace("a", "q", 1), 3: t + "\nl1\nl2\nl3\n" + t}.get(k % 6, t))
    rng.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, None, None, 1, 2, "d", "b", 3, "c") for k, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_substring(docs, rows, monkeypatch):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(substring_dedup.substring_dedup(docs), *names) == sorted(brute.substring(rows))


@pytest.mark.parametrize("bucket, most, block", [(8, 2, 1 << 21), (4, 1, 700), (4096, 8192, 450)])
def test_substring_bounds(spark, docs, rows, bucket, most, block, monkeypatch):
    """Crowded anchors, many buckets and texts read in blocks give the same."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    found = {r["doc_id"]: r["ranges"] for r in substring_dedup.covered_ranges(body, 200, bucket, most).collect()}
    for k, _, removed, spans, sha in brute.substring(rows):
        text = (dict(rows)[k] or "").encode()
        own = [(x["start"] + x["covered"][i], x["start"] + x["covered"][i + 1]) for x in found.get(k, []) for i in range(0, len(x["covered"]), 2)]
        kept, n, m = substring_dedup.remove(text, own)
        assert (n, m, hashlib.sha256(kept).hexdigest()) == (removed, spans, sha)


@pytest.mark.parametrize("shard", [1, 3, 50])
def test_merged_transforms(shard):
    """Intervals of merged transforms against all windows, with weights, and the transforms and interleave against sorting."""
    rng = np.random.default_rng(shard)
    parts = [bytes(rng.integers(97, 99, 40).astype(np.uint8)) for _ in range(4)]
    seg = []
    for _ in range(40):
        text = b"".join(parts[i] for i in rng.integers(0, 4, rng.integers(5, 9)))
        seg.append(text[rng.integers(0, 3) : len(text) - rng.integers(0, 3)])
    seg = [x for x in seg if len(x) >= 200] + [seg[0]]
    span = np.array([len(x) for x in seg])
    weight = np.array([1 + k % 3 // 2 for k in range(len(seg))])
    times = Counter()
    for x, w in zip(seg, weight, strict=True):
        for i in range(len(x) - 199):
            times[x[i : i + 200]] += int(w)
    owner, inside = substring_dedup.repeated_windows(b"".join(seg), np.cumsum(span) - span, span, weight, shard=shard)
    expected = {(k, i) for k, x in enumerate(seg) for i in range(len(x) - 199) if times[x[i : i + 200]] > 1}
    assert sorted(zip(owner.tolist(), inside.tolist(), strict=True)) == sorted(expected)
    texts = [[int(c) for c in rng.integers(1, 4, rng.integers(1, 8))] for _ in range(12)]
    shards, ends, sorted_ = [], [], []
    for at in range(0, 12, 4):
        own = texts[at : at + 4]
        symbols = np.array([c for t in own for c in t])
        after = np.array([k + 1 if j + 1 < len(t) else -1 for t, start in zip(own, np.cumsum([0] + [len(t) for t in own]), strict=False) for j, k in enumerate(range(start, start + len(t)))])
        order = substring_dedup.transform(symbols, after)
        tails = [tuple(t[j:]) for t in own for j in range(len(t))]
        before = np.array([t[j - 1] if j else 0 for t in own for j in range(len(t))])
        assert [tails[k] for k in order] == sorted(tails)
        last = np.flatnonzero(after < 0)
        shards.append(np.concatenate([symbols[last], before[order]]))
        ends.append(len(last))
        sorted_.append([()] * len(last) + sorted(tails))
    for depth in (1, 2, 5, 9):
        interleave, interval = substring_dedup.merge(shards, ends, depth)
        taken = [iter(x) for x in sorted_]
        rows = [next(taken[s]) for s in interleave.tolist()]
        assert [r[:depth] for r in rows] == sorted(r[:depth] for r in rows)
        assert [a == b for a, b in zip(interval[1:].tolist(), interval[:-1].tolist(), strict=True)] == [a[:depth] == b[:depth] for a, b in zip(rows[1:], rows[:-1], strict=True)]


def test_substring_blocks():
    """Blocks of any size own each window once."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 100, 5000).astype(np.uint8))
    for block in (300, 1000, 1 << 21):
        substring_dedup.BLOCK, old = block, substring_dedup.BLOCK
        try:
            windows = [(s + i) for _, start, span, *_ in substring_dedup._blocks(pa.array([text], pa.binary()), 200) for s, n in zip(start, span, strict=True) for i in range(n - 199)]
        finally:
            substring_dedup.BLOCK = old
        assert sorted(windows) == list(range(5000 - 199))


def test_rolling_hash():
    x = np.frombuffer(b"abcabcabdabc" * 9, np.uint8)
    for n in (1, 3, 32, 40):
        h = substring_dedup.rolling(x, n)
        by = defaultdict(set)
        for i, v in enumerate(h.tolist()):
            by[v].add(bytes(x[i : i + n]))
        assert len(h) == len(x) - n + 1 and all(len(s) == 1 for s in by.values()) and len(by) == len({bytes(x[i : i + n]) for i in range(len(h))})


def test_repeated_rows(spark):
    text = words(random.Random(3), 80)
    twice = frame(spark, [(1, text), (1, text), (2, "short"), (None, text), (None, None)])
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(twice).where("n_bytes > 100").collect()] == [len(text)] * 3
    assert sorted((r["doc_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(twice).collect()) == [(0, 1, False), (0, 3, False), (1, 3, True), (1, 3, True), (2, 1, True)]
    assert line_dedup.line_dedup(twice).count() == 5 and packing.pack(twice, vocabulary("word_bpe_49k.json")).count() == 5
    assert simhash.simhash_dedup(twice).count() == 5 and mixing.mix(twice).count() >= 5


def test_token_counts(docs, rows):
    path = vocabulary("piece_bpe_32k.model")
    pieces, known = brute.pieces_of(path), {}
    for _, t in rows:
        for w in (t or "").split():
            if w not in known and len(w) < 100:
                known[w] = brute.greedy(w, pieces)
    for k, n_words, n_tokens, n_unknown in got(token_counts.token_counts(docs, path), "doc_id", "n_words", "n_tokens", "n_unknown"):
        own = (dict(rows)[k] or "").split()
        if all(w in known for w in own):
            assert (n_words, n_tokens, n_unknown) == (len(own), sum(abs(known[w]) for w in own), sum(known[w] < 0 for w in own))


def test_token_counts_long_words():
    """Long words are counted again each time and not kept."""
    counter = token_counts.Counter(token_counts.load(vocabulary("piece_bpe_32k.model")))
    once = counter.text("the " + "ab" * 5000 + " end")
    assert counter.text(("the " + "ab" * 5000 + " end ") * 3) == tuple(3 * x for x in once) and once[0] == 3
    assert max(map(len, counter.known)) <= token_counts.LONGEST_KEPT


def test_automaton_small():
    pieces = ["▁", "▁a", "▁abc", "b", "c", "cd", "bcdx", "d"]
    a, rng = token_counts.Automaton(pieces), random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("abcdx") for _ in range(rng.randint(0, 9)))
        assert a.count(w) == brute.greedy(w, pieces), w
    assert token_counts.Counter(a, cache=2).text("abcd bb\tzz abcd") == (4, 2 + 3 + 1 + 2, 1)
    assert "".join(token_counts.chunks("ab cd ef gh", 3)) == "ab cd ef gh"


def test_mixing_uses_all_and_meets_the_limit(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, rng.randint(0, 60)), None, "hot" if k % 3 else f"s{k % 4}", 0, 0, "", "", 0, "c") for k in range(900)] + [(2000, None, None, None, 0, 0, "", "", 0, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, max_repeats=1.5).collect()
    uses = Counter(r["doc_id"] for r in out)
    size, used = Counter(), Counter()
    for k, t, _, s, *_ in rows:
        size[s] += len((t or "").split())
    for r in out:
        used[r["source"]] += r["__tokens"]
    assert set(uses) == {r[0] for r in rows} and max(uses.values()) == 2
    ratio = {s: used[s] / size[s] for s in size if size[s]}
    assert ratio["hot"] == 1 and abs(max(ratio.values()) - 1.5) < 0.05
    share = {s: size[s] / sum(size.values()) for s in size if size[s]}
    a = 1 - np.log(1.5) / np.log(max(share.values()) / min(share.values()))
    for s in share:
        assert abs(ratio[s] - (share[s] / max(share.values())) ** (a - 1)) < 0.05
    assert len({(r["source"], r["__epoch"], r["__order"]) for r in out}) == len({(r["source"], r["__epoch"], r["__block"]) for r in out})


def test_mixing_entropy_and_budget(spark):
    sizes = spark.createDataFrame([(1000,), (100,), (10,), (0,)], "tokens long")
    p = np.array([1000, 100, 10]) / 1110
    for goal in (0.5, 0.8, 0.999):
        a, _ = mixing.exponent(sizes, goal, None, None)
        w = p**a / (p**a).sum()
        assert abs(-(w * np.log(w)).sum() - goal * np.log(3)) < 1e-3
    a, spent = mixing.exponent(sizes, None, 2.0, 1110)
    assert spent == 1110 and abs(1110 * 10**a / (1000**a + 100**a + 10**a) / 10 - 2) < 1e-3
    rng = random.Random(6)
    docs = frame(spark, [(k, words(rng, 20)) for k in range(200)])
    assert abs(sum(r["__tokens"] for r in mixing.mix(docs, budget=1000, max_repeats=None, target_entropy=0.1).collect()) - 1000) <= 20


@pytest.mark.parametrize("block_tokens, seed", [(40, 0), (7, 3), (10**6, 0)])
def test_mixing_brute(spark, block_tokens, seed):
    """Uses of documents against brute force, with many and few blocks, repeated and null ids, ties and clashing columns."""
    rng = random.Random(seed)
    rows = [(k if k % 50 else k // 2 * 2, " ".join("w" * rng.randint(0, 1) for _ in range(30)), f"s{k % 3 * (k % 7 > 2)}", k, -1) for k in range(400)] + [(900, None, "s1", 0, -1), (901, "", "empty", 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `__tokens` long, tokens long")
    facts = [(i, s, len((t or "").split())) for i, t, s, *_ in rows]
    size = Counter()
    for _, s, n in facts:
        size[s] += n
    a, spent = mixing.exponent(spark.createDataFrame([(n,) for n in size.values()], "tokens long"), None, 2.5, None)
    share = {s: (n / sum(size.values())) ** a for s, n in size.items() if n}
    want = {s: round(spent * x / sum(share.values())) for s, x in share.items()}
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("k")).collect()}
    blocks = spark.createDataFrame([(s, b, f) for s in size for b in range(max(1, -(-size[s] // block_tokens))) for f in range(1, 4)], "s string, b long, f int")
    order = {(r["s"], r["b"], r["f"]): r["h"] for r in blocks.select("*", F.xxhash64(F.concat(F.lit("s"), F.col("s")), "b", "f", F.lit(seed)).alias("h")).collect()}
    expected = brute.mix(facts, keys, lambda *x: order[x], want | {"empty": 0}, block_tokens)
    out = mixing.mix(docs, max_repeats=2.5, seed=seed, block_tokens=block_tokens)
    assert mixing.own_names(docs)["tokens"] == "___tokens" and out.columns == [*docs.columns, "___tokens", "__epoch", "__block", "__order"]
    got_ = out.collect()
    assert Counter(r["doc_id"] for r in got_) == expected
    assert all(r["___tokens"] == len((r["text"] or "").split()) and r["tokens"] == -1 for r in got_)
    counted = mixing.mix(docs, tokens=F.length("text"), seed=seed)
    assert all(r["___tokens"] == len(r["text"] or "") for r in counted.collect())


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for k in range(300)] + [(300, None), (350, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5), (500, [0.0] * 6), (550, [0.25] * 6), (600, [0.25] * 6)]
    df = spark.createDataFrame([(k, v, 7, 8) for k, v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    expected = sorted(brute.top_k(vectors, lambda k: k % 50 == 0))
    names = ("query_id", "rank", "vec_id", "score")
    assert got(topk.top_k(df, F.col("vec_id") % 50 == 0), *names) == expected
    assert got(topk.top_k(df, F.col("vec_id") % 50 == 0, block=40, chunk=3), *names) == expected
    few = df.where("vec_id in (0, 1, 2)")
    assert got(topk.top_k(few, F.col("vec_id") % 50 == 0), "query_id", "rank") == [(0, 1), (0, 2)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_stops_early():
    """Lists are read only as far as the bound asks."""
    values = np.arange(4000)
    lists = topk.SortedLists(np.arange(4000), np.stack([values, values], axis=1).astype(np.int64))
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[0], slice):
                read.append(key[0].stop - key[0].start)
            return super().__getitem__(key)

    lists.order = lists.order.view(Watched)
    assert lists.top(-1, np.array([1, 2]), 5) == [(3 * x, x) for x in (3999, 3998, 3997, 3996, 3995)] and sum(read) < 100


def test_line_dedup(docs, rows):
    expected = brute.line_dedup(rows)
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.line_dedup(docs).collect()} == expected
    assert sum(v[1] for v in expected.values()) > 0


def test_line_dedup_merges_cover(spark):
    a = "\n".join("abcdefg")
    df = frame(spark, [(1, a), (2, "x\n" + a + "\ny"), (3, "\n\n\n\n"), (4, "\n\n\n\n"), (5, "a\nb"), (6, "q\nq\nq\nq\nq"), (7, a)])
    out = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.line_dedup(df).collect()}
    assert out == {1: (0, a), 2: (7, "x\ny"), 3: (0, "\n\n\n\n"), 4: (0, "\n\n\n\n"), 5: (0, "a\nb"), 6: (4, "q"), 7: (7, "")}
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in line_dedup.line_dedup(df)._jdf.queryExecution().toString()]


def test_packing(docs, rows):
    out = packing.pack(docs, vocabulary("word_bpe_49k.json"), shard=20).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(brute.cut(rows))
    for places in brute.by(out, "sequence_id", "offset", "length").values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_shards_meet(spark):
    """What many small shards leave open is packed together, nothing is lost, and offsets have no gaps."""
    rng = random.Random(2)
    rows = [(k, words(rng, rng.randint(1, 40))) for k in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), length=256, shard=20).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(brute.cut(rows, 256))
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        ends = [0]
        for offset, n in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 256
    assert len(held) <= 1.06 * sum(r["length"] for r in out) / 256 + 1


def test_best_two_fit():
    bins, offsets = packing.best_two_fit(np.array([6, 3, 3, 2, 2]), 10)  # 6 + 3 leaves 1; 6 + 2 + 2 is full
    assert bins[0] == bins[3] == bins[4] and bins[1] == bins[2] and len(set(bins)) == 2
    rng = np.random.default_rng(1)
    for top in (30, 400, 4096):
        lengths = rng.integers(1, top + 1, 3000)
        bins, offsets = packing.best_two_fit(lengths, 4096)
        assert np.bincount(bins, lengths).max() <= 4096 and len(set(bins)) <= -(-lengths.sum() // 4096) * 1.02 + 1


def test_encoder_is_whole_text():
    e = packing.Encoder(vocabulary("word_bpe_49k.json"), cache=3)
    tok = packing.load(vocabulary("word_bpe_49k.json"))
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("aaßüÿªµ..,, éE'sẞΣςİ 1½\n\t\r \x85\xa0\x1c\x0bé̀<|>日.!#%") for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", " don't I'LL "])
        assert np.frombuffer(e.text(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    long = "ab cde " * 200_000
    assert np.frombuffer(e.text(long), "<u4").tolist() == tok.encode(long, add_special_tokens=False).ids


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p><p>no, no, no";</script></head><body class="page"><header><h2>Site, name, of, things</h2></header>
<nav><ul><li><a href="/a">one, two</a></li></ul></nav><div id="cookie-notice"><p>We use, cookies, and more, cookies here.</p></div><div class="sidebar"><p>Side, text, that, is, long, enough, to, count, for, a, paragraph.</p></div>
<article><header><h1>The &amp; head</h1></header><p>First,&nbsp; paragraph&#33; with <b>bold<br>words</b> and a <a href="x">link</a>.<p>Second &lt;one&gt;,
 over lines.<div class="ad">Buy, buy, buy</div><ul><li>item one<li>item two</ul><form><p>Your name</p></form><div class="comments"><p>A reader, says, so.</p></div></article>
<aside><p>More, of, it</p></aside><footer><p>&copy; us, 2020, and, others</p></footer></body></html>"""


def test_html():
    assert html_text.extract(PAGE) == "The & head\nFirst, paragraph! with bold words and a link.\nSecond <one>, over lines.\nitem one\nitem two"
    for broken in (None, "", "<", "<p", "</p></div>", "<a href='x", "<!-- no end <p>x", "<script>x", "&#xZZ;", "<p>" * 3000, "<div>" * 3000 + "x"):
        assert isinstance(html_text.extract(broken), str)
    assert html_text.extract("<div>plain &eacute;</div>") == "plain é"


def test_html_without_article():
    body = "".join(f"<p>Paragraph {k}, which goes on, and on, for a good while so that it counts as text.</p>" for k in range(4))
    links = "".join(f'<li><a href="/{k}">A link with a long title, number {k}, to somewhere else</a></li>' for k in range(30))
    page = f"<body><div class='menu'><ul>{links}</ul></div><div><div class='c1'>{body}</div><div class='links'><ul>{links}</ul></div></div><div class='footer'>f</div></body>"
    assert html_text.extract(page).split("\n") == [f"Paragraph {k}, which goes on, and on, for a good while so that it counts as text." for k in range(4)]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 50_000 + "</x>" * 50_000, '<a "' * 200_000, '<a "' * 200_000 + ">", "<x><table><td>" + "<div>" * 50_000 + "</x>" * 50_000, "<div>" * 50_000 + "<header>h</header>" * 50_000, "<script>" + "</script " * 90_000, "<!--" * 200_000, "<p>" * 90_000, "<ul><li>" * 40_000, "<" * 200_000], ids=range(11))
def test_html_takes_linear_time(page):
    began = time.process_time()
    assert isinstance(html_text.extract(page), str)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("inside, stays", [
    ('<p class="footnotes">x</p>', True), ('<div class="message"><p>x</p></div>', True), ('<section id="notice-period">x</section>', True), ('<p class="share-prices">x</p>', True), ("<math>x</math>", True), ("<label>x</label>", True),
    ("<header><p>x</p></header>", True), ('<div class="byline">x</div>', True), ('<div class="cookie-notice">x</div>', False), ('<div class="ad">x</div>', False), ('<div class="ad-slot-2">x</div>', False), ('<div id="comments"><p>x</p></div>', False),
    ('<div class="siteSidebar">x</div>', False), ('<ul class="comment-list"><li>x</li></ul>', False), ("<aside>x</aside>", False), ("<form><label>x</label></form>", False), ('<div role="navigation">x</div>', False),
])
def test_html_drops_what_is_named_only(inside, stays):
    page = f"<body><nav>menu</nav><header>site</header><article><h1>T</h1><p>Some text, with commas, and more of it to come.</p>{inside}</article><footer>f</footer></body>"
    assert html_text.extract(page).split("\n") == ["T", "Some text, with commas, and more of it to come.", *(["x"] if stays else [])]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t", 3), (2, None, None, "t", 3), (None, "u", "", "t", 3), (1, "u", PAGE, "t", 3)], "page_id long, url string, html string, text string, n_chars int")
    out = sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in html_text.extract_pages(df).collect())
    assert len(out) == 4 and all(n == m for _, n, m in out) and out[0][1] == 0
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_simhash(docs, rows):
    prints = {k: brute.simhash(t) for k, t in rows}
    roots = brute.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(docs).collect()}
    assert out == {k: (f"{prints[k]:016x}", roots[k]) for k in prints}


@pytest.mark.parametrize("bucket", [0, 2, 64])
def test_simhash_links(spark, bucket):
    """Every plan and bucket bound finds the components of all pairs within two bits."""
    rng = random.Random(9)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    signed = {simhash._signed(x): x for x in prints}
    fps = spark.createDataFrame([(x,) for x in signed], "fp long").cache()
    expected = brute.components(list(signed), lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 2)
    n, both = simhash.bit_statistics(fps)
    assert n == len(prints)
    whole = [([*range(64)], 2)]
    for chosen in (simhash.plan(n, both), [(b, t) for b, t in zip(simhash.arrange(n, both, 2), (1, 0), strict=True)], whole)[: 3 if bucket else 2]:
        assert sum(t + 1 for _, t in chosen) == 3
        root = {r["node"]: r["root"] for r in connected_components(simhash.links(fps, chosen, bucket=bucket)).collect()}
        assert {x: root.get(x, x) for x in signed} == expected


@pytest.mark.parametrize("block", [3, 64])
@pytest.mark.parametrize("stars", [0, 2])
def test_near_texts(spark, block, stars, monkeypatch):
    """Groups and chains of near copies around the threshold, with nulls, short texts and repeats, against brute force."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "STARS", stars)
    rng, rows = random.Random(11), []
    for group in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(150)]
        for _ in range(9):  # each from the one before or the first, with one to four words changed
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(150)] = f"v{rng.randrange(4000)}"
            rows.append((7 * len(rows) % 101, " ".join(words)))
            base = words if group % 2 else base
    rows += [(k, t) for k, t in zip(range(200, 211), ["", None, " \n", "one two", "ONE two", "one three", "a b c d e", "a b c d e f", rows[0][1].upper(), "p q r s t " * 4, "p q r s t " * 4 + "p q r s t p"], strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs).collect()} == brute.near(rows)


@pytest.mark.parametrize("stars", [0, 2])
def test_near_texts_at_the_threshold(spark, stars, monkeypatch):
    """Pairs at the threshold and just under it that share a bucket, decided by their whole sets."""
    monkeypatch.setattr(similar, "STARS", stars)
    texts, expected = [], {}
    for seed, n in ((315, 184), (2363, 184), (1449, 180), (6752, 180)):
        rng = random.Random(seed)
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for k in range(4):
            b[n // 5 * (k + 1)] = f"v{rng.randrange(10**6)}"
        assert (brute.jaccard(" ".join(a), " ".join(b)) >= 0.8) == (n == 184)
        k = len(texts)
        texts += [" ".join(a), " ".join(b)]
        expected |= {k: k, k + 1: k if n == 184 else k + 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs).collect()} == expected


def test_forest_is_linear():
    """All pairs of a large group are near, or none is: fewer links than members, and the components of all pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40).astype("<u8")
    sets = [np.unique(np.append(np.delete(base, rng.integers(40)), rng.integers(0, 2**63, k % 9).astype("<u8"))) for k in range(120)]
    roots, every = np.arange(120), np.arange(120)

    def size(x, y):
        n = len(np.intersect1d(x, y))
        return n / (len(x) + len(y) - n)

    for similarity in (0.8, 0.95, 0.999):
        met = similar.forest(sets, roots, every, every, similarity)
        assert len(met) < 120 and all(size(sets[a], sets[b]) >= similarity - 1e-9 for a, b in met)
        links = {tuple(sorted(p)) for p in met}
        every_link = brute.components(range(120), lambda a, b: size(sets[a], sets[b]) >= similarity)
        assert brute.components(range(120), lambda a, b: (a, b) in links) == every_link
    assert similar.forest([np.zeros(0, "<u8")] * 3, np.arange(3), np.arange(3), np.arange(3), 0.8) == []


def test_near_texts_edges(spark):
    """Null ids, rows repeated with one id, clashing columns, an empty table."""
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (4, "x y z", 2), (4, "x y z", 3), (2, "A B c d e f", 4)], "doc_id long, text string, fp int")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_dedup(docs).collect()) == [(0, 2), (2, 2), (4, 4), (4, 4)]
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_simhash_allocation():
    both = np.full((64, 64), 25.0) + np.eye(64) * 25
    parts = simhash.arrange(100, both, 2)
    assert sorted(sum(parts, [])) == list(range(64))
    small, many = simhash.plan(1000, both * 10), simhash.plan(10**10, both * 10**8)
    assert [t for _, t in small] == [0, 0, 0] and sorted(t for _, t in many) == [0, 1]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    nodes = sorted({x for p in pairs for x in p})
    linked = set(pairs)
    expected = brute.components(nodes, lambda a, b: (a, b) in linked or (b, a) in linked)
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: out.get(k, k) for k in nodes} == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("snapshot", [None, "doc_id < 60", "false", "true"])
def test_exact(docs, rows, snapshot):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    expected = sorted((k, max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    out = exact_dedup.exact_dedup(docs, None if snapshot is None else F.expr(snapshot), bucket_keys=7)
    assert got(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected


def test_exact_compares_texts(spark):
    """Two compressed forms of one text are one text; two texts under one digest end the job."""
    import zstandard

    text = b"some text " * 200
    one, two = (zstandard.ZstdCompressor(level=1, write_checksum=c).compress(text) for c in (False, True))
    assert one != two
    same = spark.createDataFrame([([bytearray(one), bytearray(two)],), ([bytearray(one)],)], "forms array<binary>")
    assert {bytes(r[0]) for r in same.select(exact_dedup._same(F.col("forms"))).collect()} == {one}
    other = zstandard.ZstdCompressor().compress(text + b"x")
    with pytest.raises(Exception, match="one SHA-256 digest"):
        spark.createDataFrame([([bytearray(one), bytearray(other)],)], "forms array<binary>").select(exact_dedup._same(F.col("forms"))).collect()


@pytest.mark.parametrize("text", [None, "", "x", "y" * 300_000])
def test_exact_without_a_snapshot(spark, text):
    """An empty snapshot, and texts of any length."""
    rows = [(1, text), (2, text), (3, "other")]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), bucket_keys=1)
    assert got(out, "doc_id", "keep_id", "group_size", "kept") == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_fuse_filter():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.FuseFilter.build(np.append(keys, keys[:5]))
        other = rng.integers(0, 2**63, 100_000).astype(np.uint64)
        assert f.contains(keys).all() and f.contains(other).mean() < 0.008
        assert n < 10_000 or len(f.table) < 1.35 * n


def test_lang_id_accuracy(spark):
    """Held-out documents of languages made from different syllables."""
    rng = random.Random(11)
    kinds = {"aa": ["tion", "the", "ing", "and", "er"], "bb": ["eau", "ment", "que", "les", "ier"], "cc": ["sch", "ung", "der", "ein", "tz"]}
    rows = []
    for k in range(300):
        lang = rng.choice(sorted(kinds))
        rows.append((k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang, None, 0, 0, "", "", 0, "c"))
    rows += [(1000, None, "aa", None, 0, 0, "", "", 0, "c"), (1001, "12 34 !", "bb", None, 0, 0, "", "", 0, "c"), (1002, "", None, None, 0, 0, "", "", 0, "c"), (None, "the ing", "aa", None, 0, 0, "", "", 0, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = lang_id.lang_id(df, vocabulary("piece_bpe_32k.model")).collect()
    import zlib

    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), "und")
    kept = lang_id.lang_id(df, vocabulary("piece_bpe_32k.model"), keep=True)
    assert kept.columns == [*df.columns, "__lang", "__score"] and kept.count() == len(rows)


def test_lang_id_sums_segmentations():
    vocabulary_, rng = ["▁", "a", "b", "ab", "ba", "▁a", "bab"], np.random.default_rng(4)
    pieces = lang_id.Pieces(vocabulary_)
    p = rng.random((len(vocabulary_) + 1, 2)) / 8

    def total(w):
        return sum((p[pieces.ids.get(w[:k], 0 if k == 1 else -1)] * total(w[k:]) for k in range(1, len(w) + 1) if k == 1 or w[:k] in pieces.ids), np.zeros(2)) if w else np.ones(2)

    words_ = ["", "a", "ab", "abab", "babab", "axb", "bbabaab"]
    assert np.allclose(np.exp(lang_id.log_words(pieces, words_, p)), [total("▁" + w) for w in words_])
    long = "ab" * 15
    assert np.allclose(lang_id._log_long(pieces, long, p), lang_id.log_words(pieces, [long], p)[0])
    assert np.isfinite(lang_id.log_words(pieces, ["ab" * 5000], p)).all()
    assert [w for ws in lang_id.words("Ab1c d_e") for w in ws] == ["ab", "c", "d", "e"]


def test_lang_id_learns_from_whole_texts(spark):
    """What is learned is what all words of all sampled texts give, long words and long texts included; equal rows count once."""
    vocabulary_ = ["▁", "a", "b", "c", "ab", "ba", "▁a", "bab", "abc"]
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(40)) for _ in range(5)] + ["ab " * 30_000 + "cab", "12 3"]
    rows = [(k, t, "xx") for k, t in enumerate(texts)] + [(0, texts[0], "xx")] * 3 + [(50, "7 8", "yy")]
    langs, p = lang_id.train(spark.createDataFrame(rows, "doc_id long, body string, lang string"), vocabulary_)
    count = Counter(w for t in texts for ws in lang_id.words(t) for w in ws)
    pieces, size = lang_id.Pieces(vocabulary_), len(vocabulary_) + 1

    def all_(w, p):
        """Expected uses of each piece over all segmentations, one after another."""
        w, done = "▁" + w, [(1.0, np.zeros(size))] + [(0.0, np.zeros(size)) for _ in range(len(w) + 1)]
        for j in range(1, len(w) + 1):
            total, uses = 0.0, np.zeros(size)
            for k in range(1, 5):
                i = pieces.ids.get(w[max(0, j - k) : j], 0 if k == 1 else None)
                if i is not None and k <= j:
                    weight, before = done[j - k][0] * p[i], done[j - k][1].copy()
                    before[i] += 1
                    total, uses = total + weight, uses + weight * before
            done[j] = total, uses / total
        return done[len(w)][1]

    q = np.full(size, 1 / size)
    for _ in range(lang_id.ROUNDS):
        expected = np.full(size, lang_id.PRIOR) + sum(n * all_(w, q) for w, n in count.items())
        q = expected / expected.sum()
    assert langs == ["xx", "yy"] and np.allclose(p[:, 0], q) and np.allclose(p[:, 1], 1 / size)
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS body", "CASE WHEN id % 9 = 0 THEN 'p' ELSE 'q' END AS lang")
    taken = Counter(r["lang"] for r in lang_id.sample(many, 300).collect())
    assert all(abs(n - 300) < 90 for n in taken.values()) and len(taken) == 2


def test_empty_tables(empty):
    path = vocabulary("piece_bpe_32k.model")
    for out in (substring_dedup.substring_dedup(empty), token_counts.token_counts(empty, path), mixing.mix(empty), line_dedup.line_dedup(empty), packing.pack(empty, vocabulary("word_bpe_49k.json")), simhash.simhash_dedup(empty), exact_dedup.exact_dedup(empty), lang_id.lang_id(empty, path)):
        assert out.count() == 0
