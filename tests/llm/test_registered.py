"""The registered queries against brute force and SQL on the smallest tables, and the pipeline on small ones."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillgraph.llm import queries

from . import brute

DIR = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in queries.table(spark, DIR, "documents").collect()]


@here
def test_all_are_there():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]


@here
def test_op1(spark, rows):
    out = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op1(spark, DIR).collect()]
    assert sorted(out) == sorted(brute.substring([r[:2] for r in rows]))


@here
def test_op2(spark, rows):
    pieces, known = brute.pieces_of(queries.vocabulary("piece_bpe_32k.model")), {}
    first, rest = {p for p in pieces if p[0] == "▁" and "▁" not in p[1:]}, {p for p in pieces if "▁" not in p}
    longest = max(map(len, pieces))

    def count(word):
        w, i, n = "▁" + word, 0, 0
        while i < len(w):
            j = next((j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in (rest if i else first)), None)
            if j is None:
                return -1
            i, n = j, n + 1
        return n

    for w in {w for r in rows for w in (r[1] or "").split()}:
        known[w] = count(w)
    expected = {k: (len(t.split()), sum(abs(known[w]) for w in t.split()), sum(known[w] < 0 for w in t.split())) for k, t, *_ in rows}
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in queries.op2(spark, DIR).collect()} == expected


@here
def test_op3(spark, rows):
    out = queries.op3(spark, DIR).collect()
    size, used = Counter(), Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    for r in out:
        used[r["source"]] += r["n_tokens"]
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    a = 1 - np.log(1.5) / np.log(max(size.values()) / min(size.values()))
    longest = max(len((t or "").split()) for _, t, *_ in rows)
    for s in size:  # a last pass ends with the document in which its budget does
        assert -1 <= used[s] - size[s] * (size[s] / max(size.values())) ** (a - 1) <= longest, s
    epochs = {(r["doc_id"], r["epoch"]) for r in out}
    assert len(epochs) == len(out) and all((d, 0) in epochs for d, _ in epochs)


@here
def test_op6(spark, rows):
    out = queries.op6(spark, DIR).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(brute.cut([r[:2] for r in rows]))
    assert len({r["sequence_id"] for r in out}) <= -(-sum(r["length"] for r in out) // 4096) + 1


@here
def test_op7(spark):
    pages = queries.table(spark, DIR, "pages").collect()
    out = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op7(spark, DIR).collect()}
    assert out == {r["page_id"]: (r["url"], t := brute.main_text(r["html"]), len(t)) for r in pages} and len(out) == len(pages)


@here
def test_op8(spark, rows):
    prints = {k: brute.simhash(t) for k, t, *_ in rows}
    roots = brute.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8(spark, DIR).collect()} == {k: (f"{prints[k]:016x}", roots[k]) for k in prints}


@here
def test_op10(spark, rows):
    truth = {r[0]: r[2] for r in rows}
    out = queries.op10(spark, DIR).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out) and len(out) == len(rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(out.fetchall())


def small(rng):
    """Documents with near copies, shared lines, other signs and empty texts."""
    base = [" ".join(rng.choice(["the", "and", "tion", "ingly", "heron", "wast"]) + rng.choice("abcde") for _ in range(60)) for _ in range(12)]
    shared = "\n".join(["one shared line", "two shared lines", "three shared lines"])
    texts = base + [b + " extra" for b in base[:4]] + base[:2] + [f"{t}\n{shared}\n{t[::-1]}" for t in base[4:8]] + ["", None, "123 45", "!!", shared, "short text here"]
    return [(3 * k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def test_pipeline(spark, tmp_path):
    rows = small(random.Random(5))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = queries.table(spark, str(tmp_path), "documents"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == names
    kept = {k: t for k, t, *_ in rows if t and any(map(str.isalpha, t))}
    assert {r["doc_id"]: r["text"] for r in seen["language_id"]} == kept
    lines = {k: t for k, (_, n, t) in brute.line_dedup(list(kept.items())).items() if not n or t.strip()}
    assert {r["doc_id"]: r["text"] for r in seen["line_dedup"]} == lines and all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"])
    roots = brute.near(list(lines.items()))
    assert {r["doc_id"]: r["text"] for r in seen["simhash_dedup"]} == {k: lines[k] for k in set(roots.values())}
    mixed = Counter((r["doc_id"], r["text"]) for r in seen["mix_sources"])
    assert set(mixed) == {(k, lines[k]) for k in set(roots.values())} and max(mixed.values()) <= 2
    pieces = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in seen["pack"])
    assert pieces == sorted(brute.cut([x for x, n in mixed.items() for _ in range(n)]))
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["piece"]) for r in ran.collect()) == [p[:2] for p in pieces]


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeats, columns of clashing names and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__x.y` string, fp string, digest long, piece int, __id long, __lang string, __score string, __text string, __digest string, __tokens long, x5 int, body string"
    text = "some words that go on for a while " * 4
    rows = [(1, text, "en", None, 1, "a", "b", 3, 4), (1, text, "en", None, 1, "a", "b", 3, 4), (None, text + "x", "en", "s", None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, "other text\n" * 9, None, "s", 2, "a", "b", 3, 4), (6, "long words " * 60_000, "en", "s", 2, "a", "b", 3, 4)]
    rows = [(*r, 7, "l", "s", "t", "d", 8, 9, "y") for r in rows]
    for k, part in enumerate((rows, [])):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "pack":
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
                out.write.parquet(str(tmp_path / f"{k}{name}"))
                docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (out.count() > 0) == bool(part)
        assert {tuple(r)[9:] for r in docs.collect()} == ({(7, "l", "s", "t", "d", 8, 9, "y")} if part else set())


def test_pipeline_null_ids(spark, tmp_path, monkeypatch):
    """Documents with null ids stay when files are dealt to partitions anew between the jobs of a stage."""
    rng = random.Random(8)
    for k in range(7):
        rows = [(None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for _ in range(5 + 3 * k)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    docs, near = spark.read.parquet(str(tmp_path / "d")), corpus_pipeline._simhash.near_dedup

    def then_dealt_anew(*args):
        grouped = near(*args)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return grouped

    monkeypatch.setattr(corpus_pipeline._simhash, "near_dedup", then_dealt_anew)
    try:
        kept = [r["text"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(kept) == sorted(r["text"] for r in docs.collect())


def test_pipeline_shared_ids(spark):
    """Different texts of one id are documents of their own, where lines are removed and where near copies are."""
    rng = random.Random(9)
    one, two, three = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    shared = "first shared line\nsecond shared line\nthird shared line"
    rows = [(1, shared + "\nx"), (4, f"{one}\n{shared}"), (4, two), (4, two), (4, None), (5, f"{three}\n{shared}\n{one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in found) == sorted([(1, shared + "\nx"), (4, one), (4, two), (4, two), (4, ""), (5, f"{three}\n{one}")])
    rows = [(4, one), (4, two), (4, two), (2, "other words " * 9), (6, one), (7, two), (None, two), (None, three), (8, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted([(4, one), (4, two), (2, "other words " * 9), (8, three)])


def test_pipeline_without_languages(spark):
    """Nothing to learn a language from: texts with a letter stay."""
    rows = [(1, "some words", None), (2, "é", None), (3, "12 !?", None), (4, None, "en"), (None, "more words", "en"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [(0, "more words"), (1, "some words"), (2, "é")]
