"""Fill-in-middle, licence scan and ranked search: brute force on small tables, and the defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timedtext.llm import fim, lexical, licences

DOCS = "doc_id long, text string, lang string, n long, words string, term long, base string, id long"


def docs_of(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", -1, "x", 5, "b", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


# --- fill in the middle -------------------------------------------------------------------------------


def by_hand(doc_id, text, seed, transformed=90, spm=20):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= transformed:
        return n, "plain", None, None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


HARD = ["", None, "a", "ab", "\x01", "\x02", "\x020\x021\x01", "\x01\x01\x02\x02" * 9, "a\nb\r\n c", "😀é" * 7, "á", "x<P>y", "<S>", "a<M", "<<P", "<P<S<M", "$0\\1", "\\\\", "word " * 30_000]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_middles_by_hand(spark, seed):
    rng = random.Random(seed)
    texts = HARD + ["".join(rng.choice("ab<PSM>\x01\x02😀\n") for _ in range(rng.randrange(40))) for _ in range(200)]
    ids = [None, -5, 7, 7, *range(100, 96 + len(texts))]
    made = fim.transform(docs_of(spark, texts, ids), seed).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    got = Counter(tuple(r)[1:] for r in made.collect())
    want = Counter((*by_hand(i, t or "", seed), t or "") for i, t in zip(ids, texts, strict=True))
    assert got == want
    assert {k[1] for k in got} == {"plain", "psm", "spm"}


def test_marks_count_units(spark):
    rows = spark.createDataFrame([(t or "",) for t in HARD], "text string").select("text", fim.mark_units(F.col("text")).alias("m"))
    for r in rows.select("text", "m", fim.count_marks(F.col("m")).alias("n"), fim.unmark(F.col("m")).alias("back")).collect():
        assert r.n == len(r.text) and r.back == r.text and r.m.count("\x01") == r.n


def test_no_documents_have_no_middles(spark):
    assert fim.transform(docs_of(spark, [])).collect() == []


# --- licences ------------------------------------------------------------------------------------------


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def matches_by_hand(text, templates):
    """Every template at every place."""
    ws, out = words_by_hand(text), Counter()
    for t in templates:
        lo, hi = t.key_at
        for start in range(-len(t.words), len(ws)):
            same = [0 <= start + j < len(ws) and ws[start + j] == w for j, w in enumerate(t.words)]
            if sum(same) >= max(1, t.need) and all(same[lo : hi + 1]):
                out[t.label, t.share == 1.0, start, sum(same) / len(t.words)] += 1
    return ws, out


FILES = [
    None,
    "",
    "...",
    "Released under the MIT License.",
    "x Released under the mit\nLicense y",
    "Released beneath the MIT License",
    "Released under the MIT Licence",
    "Licensed under the Apache License, Version 2.0. Licensed under the apache license version 3.0",
    "apache license version 2 0",
    "under the Apache License, Version 2.0",
    "GENERAL PUBLIC LICENSE general public license",
    "All rights reserved. all rights, reserved; ALL RIGHTS RESERVEDÜ",
    "cc by cc by-nc 4.0 Licensed under CC BY-NC 4.0",
    "Licensed under CC BY 4.0",
    "ÜCC BY",
    "all rights reserved Kelvin marK",
    "permission is hereby granted, free of charge, to every person obtaining the copy of this software and associated documentation files",
    "cc by " * 3000,
    "the license " * 3000 + "all rights reserved",
]


def test_licences_by_hand(spark):
    rng = random.Random(4)
    known = sorted({w for t in licences.BASE + licences.NOTICES for w in t.words})
    texts = FILES + FILES[3:4] + [" ".join(rng.choice(known) for _ in range(30)) for _ in range(30)]
    for t in licences.NOTICES:  # notices with a word or two changed
        for k in range(3):
            ws = t.words
            for _ in range(k):
                ws[rng.randrange(len(ws))] = "other"
            texts.append("some words " + " ".join(ws).upper() + " and more")
    rows = {r.doc_id: r for r in licences.scan(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ws, want = matches_by_hand(text, licences.BASE + licences.NOTICES)
        assert rows[i].n_words == len(ws)
        assert Counter((m.label, m.base, m.start, m.share) for m in rows[i].found) == want, text
    assert any(m.share < 1 for r in rows.values() for m in r.found)


def test_any_match_holds_an_indexed_word():
    rng = random.Random(1)
    for t in licences.BASE + licences.NOTICES:
        df = {w: rng.randrange(5) for w in t.words}
        places = {p for _, _, p in licences.rare_postings((t,), df)}
        assert len(t.words) - len(places) < t.need  # all places but those of the index are too few for a match
        assert t.key in t.text


def test_no_files_have_no_licences(spark):
    assert licences.scan(docs_of(spark, [])).collect() == []


# --- ranked search -----------------------------------------------------------------------------------------


def terms_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_hand(docs, items, k):
    held = [(i, Counter(terms_by_hand(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms_by_hand(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_words
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (*x[:2], x[2] or 0))[:k])]
    return out


def test_term_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "AT_ONCE", 40)
    texts = ["", "Ab aB", "x" * 90, "é É a9-b", "a " * 70, "..", "q\x00r"]
    found = [[] for _ in texts]
    for h, i in lexical.term_blocks(texts):
        for a, b in zip(h.tolist(), i.tolist(), strict=True):
            found[b].append(a)
    names = {}
    for text, hashes in zip(texts, found, strict=True):
        want = terms_by_hand(text)
        assert len(want) == len(hashes)
        for w, h in zip(want, hashes, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize(("shard_words", "block_terms"), [(1 << 20, 100_000), (60, 7)])
def test_search_by_hand(spark, shard_words, block_terms):
    rng = random.Random(shard_words)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", "...", "Only W1", *[some(rng.randrange(1, 40)) for _ in range(300)]]
    texts += [texts[9]] * 60 + [some(4000), "rare " * 50 + some(5), "É é"]  # copies, a long one
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    ids[5] = ids[6]  # a repeated doc_id
    ids[30] = None
    items = [(0, texts[9]), (1, "W1 w1 w2"), (2, "rare é none"), (3, None), (4, ""), (5, "absent"), (6, some(30)), (6, some(3)), (None, some(5)), *[(10 + i, some(12)) for i in range(20)]]
    docs = docs_of(spark, texts, ids).repartition(3)
    got = lexical.ranked(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")), 20, shard_words, block_terms)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = ranked_by_hand(list(zip(ids, texts, strict=True)), items, 20)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_tree_stands_both_ways():
    """Down the tree a list's postings stay in the order of their impact, and leaves are documents in order."""
    rng = np.random.default_rng(3)
    doc, term = rng.integers(0, 37, 900), rng.integers(0, 25, 900) * 7
    row = lexical.tree_row(np.arange(100, 137), term, doc, 37, 900)
    tree = lexical.Tree.load(row)
    assert tree.depth == 6 and len(tree.terms) == 25
    for t in range(25):
        ranges = [(0, int(tree.offsets[t]), int(tree.offsets[t + 1]))]
        for d in range(tree.depth + 1):
            for _, lo, hi in ranges:
                assert (np.diff(tree.impact[d, lo:hi]) <= 0).all()
            if d < tree.depth:
                r, z = tree.rank0[d], int(tree.zeros[d])
                ranges = [x for p, lo, hi in ranges for x in ((2 * p, int(r[lo]), int(r[hi])), (2 * p + 1, z + lo - int(r[lo]), z + hi - int(r[hi]))) if x[1] < x[2]]
        assert [p for p, _, _ in ranges] == sorted(set(doc[term == tree.terms[t]])) and all(hi - lo == 1 for _, lo, hi in ranges)


def test_empty_tables_find_nothing(spark):
    none, item = docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(none, item).collect() == []
    assert lexical.ranked(docs_of(spark, ["a b"]), item.limit(0)).collect() == []
    assert lexical.ranked(docs_of(spark, ["", None]), item).collect() == []


@pytest.mark.parametrize("name", ["op11_marker_injection_fim", "op12_rare_token_licences", "op13_wavelet_search"])
def test_queries_match_sql(spark, name):
    import duckdb

    from timedtext.llm import registry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = registry.QUERIES[name](spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
