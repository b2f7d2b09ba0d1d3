"""The training-data operators: edge cases, and brute force where SQL cannot say what they do."""

import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F

from timedtext.llm import chat, kmtree, mixing, neardup, packing, paragraphs, pivots, repeats, tokenfiles, tokens, toxicity, urls
from timedtext.llm.components import components
from timedtext.llm.shingles import dart_signatures, occurrences, shingle_bags

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, rank string"


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), -i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- tokens, packing, files -----------------------------------------------------------------------

ODD = ["a  b", "a   b", " a", "a \n b", "x  ", "", " ", "   ", "<|endoftext|> b", "a  <|endoftext|>", "　 a", "don't 'll", "Ünï-çode ΣΑΣ İ ﬁ é", "a, b. (c) 12 x9.", "é ́x", "Wort, " * 50]


@pytest.mark.parametrize(("name", "space"), [(tokens.BYTE_LEVEL, True), (tokens.WORD_LEVEL, False)])
def test_chunked_ids_are_the_library_s(name, space):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab ., \n\té<|>'1") for _ in range(rng.randrange(60))) for _ in range(300)]
    plain = tokens.ChunkEncoder(tokens.vocabulary(name), space)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert plain.encode(texts) == want
    assert tokens.ChunkEncoder(tokens.vocabulary(name), space, memory=20).encode(texts, at_once=200) == want


def test_words_around_line_breaks_merge_once():
    encoder = tokens.ChunkEncoder(tokens.vocabulary(tokens.BYTE_LEVEL), True)
    texts = ["x Wort, ünï.\nWort ünï) \nWort Wort\n\nünï ünï.\n", "x Wort.\nÜnï! Wort\nWort's", "x Wort. Wort\n.Wort ünï\n12 ünï\nünï\nünï"]
    merged, merge = [], encoder.merge
    encoder.merge = lambda x: merged.append(x) or merge(x)
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want == encoder.encode(texts)
    assert len(merged) == len(set(merged)) and encoder.known.keys() >= {"Wort", "Wort,", "ünï"} and "ünï.\nWort" not in encoder.known


def check_packing(rows, docs, capacity):
    t = tokens.ChunkEncoder(tokens.vocabulary(tokens.BYTE_LEVEL), True)
    held = {d: ids + packing.END for d, ids in zip([d for d, _ in docs], t.encode([x or "" for _, x in docs]), strict=True)}
    seen = dict.fromkeys(held, 0)
    bins = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == seen[r.doc_id] and 0 < r.length <= capacity
        seen[r.doc_id] += r.length
        assert zlib.crc32(held[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: 4 * n for d, n in seen.items()} == {d: len(x) for d, x in held.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    rng = random.Random(3)
    texts = [None, "", "same", "same", *[words(rng, rng.randrange(1, 400)) for _ in range(60)], words(rng, 3000)]
    docs = docs_of(spark, texts)
    rows = packing.pack(packing.pieces(docs, 512), 512, block_items=40, islands=2).collect()
    n = check_packing(rows, list(enumerate(texts)), 512)
    assert n <= 1.05 * sum(r.length for r in rows) / 512 + 2
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_evolution_beats_its_start():
    rng = random.Random(4)
    lengths = [x for _ in range(60) for x in (rng.randrange(30, 60),) for x in (x, rng.randrange(20, 35), 0) if x]
    lengths += [100 - x for x in lengths]
    start = [packing.best_fit(lengths, 100, rng, 0.6)]
    best = packing.evolve(lengths, start, 100, rng, 6, 60)
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in best) and packing.score(best, lengths, 100) <= packing.score(start[0], lengths, 100)


def test_breeding_beats_best_fit():
    """Forty bins' worth of triples that fill a bin each: fewer bins than best-fit without noise, and than all noisy starts of the population."""
    rng, lengths = random.Random(1), []
    for _ in range(40):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (1000 - a) // 2 + 1)
        lengths += [a, b, 1000 - a - b]
    rng.shuffle(lengths)
    plain = packing.best_fit(lengths, 1000, random.Random(0), 0.0)
    unbred = packing.evolve(lengths, [plain], 1000, random.Random(1), 12, 0)
    bred = packing.evolve(lengths, [plain], 1000, random.Random(1), 12, 800)
    assert sorted(i for b in bred for i in b) == list(range(120)) and all(sum(lengths[i] for i in b) <= 1000 for b in bred)
    assert len(bred) < min(len(plain), len(unbred))


def fewest_bins(lengths, capacity):
    """The exact optimum, over all subsets: (bins, least room used in the last one) of each."""
    best = {0: (1, 0)}
    for mask in range(1 << len(lengths)):
        bins, used = best[mask]
        for i, n in enumerate(lengths):
            if not mask >> i & 1:
                now = (bins, used + n) if used + n <= capacity else (bins + 1, n)
                if now < best.get(mask | 1 << i, (99, 0)):
                    best[mask | 1 << i] = now
    return best[(1 << len(lengths)) - 1][0]


def test_packing_of_small_sets_is_optimal():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [rng.randrange(10, 70) for _ in range(10)]
        plain = packing.best_fit(lengths, 100, rng, 0.0)
        assert len(packing.evolve(lengths, [plain], 100, rng, 8, 100)) == fewest_bins(lengths, 100)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)).view(np.uint64)
    tree, _ = tokenfiles.PerfectHash.load(tokenfiles.PerfectHash.of(keys).dump())
    assert sorted(tree.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        tokenfiles.PerfectHash.of(np.array([1, 1], np.uint64))


def token_files(spark, docs):
    root = tokenfiles.shared_path(spark, "t")
    tokenfiles.store(root)[0].create_dir(tokenfiles.store(root)[1])
    manifest = tokenfiles.cut(tokenfiles.write_shards(docs, root, tokens.vocabulary(tokens.WORD_LEVEL), 3), "m")
    return root, manifest, tokenfiles.cut(tokenfiles.build_index(manifest, root, 3), "i")


def test_token_files(spark):
    texts = [None, "", "Hello, World", "a b"]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["again", "more"]).withColumn("doc_id", F.lit(2).cast("long")))
    root, manifest, index = token_files(spark, docs)
    keys = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 99, -5)], "key long")
    found = tokenfiles.lookup(keys, index, root, 3)
    # a key's records may go on in the next shard, as another run
    assert sorted((r.key, r["n"]) for r in found.groupBy("key").agg(F.sum("count").alias("n")).collect()) == [(0, 1), (1, 1), (2, 3), (3, 1)]
    rows = tokenfiles.read_records(found, manifest.select("shard", "file").distinct(), root, 3).collect()
    want = sorted(zlib.crc32(x + np.array([1], "<u4").tobytes()) for x in tokens.ChunkEncoder(tokens.vocabulary(tokens.WORD_LEVEL), False).encode(["", "", "Hello, World", "again", "more", "a b"]))
    assert sorted(r.ids_crc32 for r in rows) == want
    assert token_files(spark, docs.limit(0))[1].count() == 0


def test_one_key_over_many_shards(spark):
    """Null doc_ids and one id for many rows spread over shards, and every record is found again."""
    docs = spark.range(400).select(F.when(F.col("id") < 150, F.lit(7)).when(F.col("id") < 300, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    root = tokenfiles.shared_path(spark, "t")
    tokenfiles.store(root)[0].create_dir(tokenfiles.store(root)[1])
    manifest = tokenfiles.cut(tokenfiles.write_shards(docs, root, tokens.vocabulary(tokens.WORD_LEVEL), 8), "m")
    held = manifest.groupBy("key").agg(F.countDistinct("shard").alias("n")).filter("n > 1").collect()
    assert {r.key for r in held} >= {7, tokenfiles.NULL_KEY}
    rows = tokenfiles._written_and_read(docs, root, 8, 3, 5).collect()
    where, base = tokenfiles.store(root)
    assert len([f for f in where.get_file_info(FileSelector(base)) if f.base_name.startswith("index-")]) > 5
    encoder = tokens.ChunkEncoder(tokens.vocabulary(tokens.WORD_LEVEL), False)
    want = sorted(zlib.crc32(x + np.array([1], "<u4").tobytes()) for x in encoder.encode([r.text for r in docs.collect()]))
    assert sorted(r.ids_crc32 for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None] * 150 + [7] * 150 + list(range(300, 400))


def test_long_chunks_are_not_kept():
    encoder = tokens.ChunkEncoder(tokens.vocabulary(tokens.BYTE_LEVEL), True, memory=4000)
    texts = ["x " + "漢字" * 5000, *[f"word{i} other{i}" for i in range(200)]]
    plain = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts, at_once=100) == plain and encoder.encode(texts) == plain
    encoder.encode(["a b"])
    assert max(map(len, encoder.known)) <= tokens.LONG_CHUNK and len(encoder.known) < 450


def test_token_file_query_against_the_library(spark):
    got = {r.doc_id: r for r in tokenfiles.op3_perfect_hash_ids(spark, D).collect()}
    t, at = tokens.ChunkEncoder(tokens.vocabulary(tokens.WORD_LEVEL), False).tokenizer, 0
    for d in spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect():
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 1]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# --- urls -----------------------------------------------------------------------------------------


def judged(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, host string")
    return {r.page_id: r for r in urls.judge(pages, **options).collect()}


def test_url_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?y#z", None), (2, "https://x.net/", None), (3, "https://x.net", None), (4, "http://example.com/de/1", None), (5, "http://notexample.com/de/1", None), (6, None, None), (7, "no scheme", None), (8, "http://b.org/fr/?a://b/", None), (9, "http://É.ORG/fr/", None)]
    got = judged(spark, rows)
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(1, 10)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("x.net", "/", "net/", "block"),
        ("x.net", "", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("notexample.com", "/de/1", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b.org", "/fr/", "org/fr/", "allow"),
        ("É.org", "/fr/", "org/fr/", "allow"),
    ]


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="http://{h}/p">t</a>' for h in hosts)
    rows = [(1, "http://bad.net/", ""), (2, "http://farm.com/", link("bad.net")), (3, "http://good.org/fr/", link("friend.com")), (4, "http://friend.com/", ""), (5, "http://far.com/", link("farm.com", "friend.com"))]
    got = judged(spark, rows)
    assert [got[k].verdict for k in range(1, 6)] == ["block", "block", "allow", "allow", "block"]
    # against a dense computation
    hosts = ["bad.net", "farm.com", "good.org", "friend.com", "far.com"]
    a = np.zeros((5, 5))
    for i, j in ((1, 0), (2, 3), (4, 1), (4, 3)):
        a[j, i] = 1  # distrust goes against the link
    share = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
    seed = np.array([1.0, 0, 0, 0, 0])
    rank = 0.15 * seed
    for _ in range(20):
        rank = 0.15 * seed + 0.85 * share.T @ rank
    by_host = {r.host: r.distrust for r in got.values()}
    assert np.allclose([by_host[h] for h in hosts], rank)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- toxicity --------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["vermin", "scoundrel", "wretch"]
    texts = [words(rng, 60, 300) + (" " + rng.choice(bad) + rng.choice(["", "s", "ly"]) if i % 6 == 0 else "") for i in range(600)] + ["", None]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)] + [(1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, toxicity.outside_fold())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[600] == got[601]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {True}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


# --- vectors --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long"


def cloud(spark, n=300, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    for i in range(0, n // 3):
        x[n - 1 - i] = x[i] + rng.normal(scale=0.05, size=16)
    x[n // 2] = x[0]
    rows = [(i, [float(v) for v in r], 0, i) for i, r in enumerate(x)]
    odd = [(n, None, 0, 0), (n + 1, [0.0] * 16, 0, 0), (n + 2, [float("nan")] * 16, 0, 0), (n + 3, [float("inf")] + [1.0] * 15, 0, 0), (n + 4, [None] + [1.0] * 15, 0, 0), (n + 5, [1.0], 0, 0)]
    return x.astype(np.float64), spark.createDataFrame(rows + odd, VECTORS)


def test_near_vectors(spark):
    x, df = cloud(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while not (label == (low := np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1)))).all():
        label = low
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(got) == len(x) + 6
    assert sum(got[i].n_links for i in range(len(x))) >= 0.98 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.98
    assert all((got[len(x) + k].n_links, got[len(x) + k].kept) == (0, True) for k in range(6))
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_tiles_count_each_pair_once(spark, monkeypatch):
    _, df = cloud(spark)
    want = sorted(pivots.near_vectors(df).collect())
    monkeypatch.setattr(pivots, "TILE", 3)
    assert sorted(pivots.near_vectors(df).collect()) == want


def test_every_length_is_compared(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.1]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (7, 1, 7, True), (7, 1, 7, True)]


@pytest.mark.parametrize("dim", [64, 256])
def test_pairs_at_the_threshold_share_points(dim):
    """Recall of the index at a cosine just over 0.9, also where points are many and searched by cells."""
    rng = np.random.default_rng(dim)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(6000, dim)))
    side = rng.normal(size=(1000, dim))
    side = unit(side - (side * x[:1000]).sum(axis=1, keepdims=True) * x[:1000])
    near = 0.902 * x[:1000] + np.sqrt(1 - 0.902**2) * side
    for n in (10_000, 250_000):
        index = pivots.build({dim: x}, {dim: 1.0}, n, 0.9, 1)
        count, weight = pivots._shared(index.describe(x[:1000]), index.describe(near))
        assert ((count >= pivots.SHARED) & (weight >= index.least[dim] - 1e-4)).mean() >= 0.95, n


def test_pairs_of_points_name_lists_where_there_are_too_many(spark, monkeypatch):
    _, df = cloud(spark)
    want = sorted(pivots.near_vectors(df).collect())
    monkeypatch.setattr(pivots, "LIST", 10**9)  # few points
    few = sorted(pivots.near_vectors(df).collect())
    monkeypatch.setattr(pivots, "tile_links", lambda d, n, index, t, real=pivots.tile_links: real(d, 10**15, index, t))
    assert sorted(pivots.near_vectors(df).collect()) == few
    assert sum(r.n_links for r in few) >= 0.97 * sum(r.n_links for r in want)


def test_tree_search(spark):
    x, df = cloud(spark, 600)
    rows = kmtree.search(df, F.col("vec_id") % 50 == 0, most_sampled=400).collect()
    found, all_ = 0, 0
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        found += len({r.vec_id for r in mine} & set(order))
        all_ += 10
    assert found >= 0.9 * all_
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in kmtree.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 3), (2, 5)]
    assert kmtree.search(few.limit(0), F.lit(True)).count() == 0


def brute_neighbours(x, q, ids, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]


def test_a_tree_that_grows_in_tasks(spark, monkeypatch):
    """Leaves over the bound are grown from their own vectors; equal vectors stay a leaf; recall is against brute force."""
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 60)
    rng = np.random.default_rng(31)
    x = rng.normal(size=(1500, 8)).astype(np.float32).astype(np.float64)
    x[1000:1200] = x[1000]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    forest = kmtree.Forest({8: kmtree.grow(x[:40], leaf_points=30)})
    placed = kmtree.put(df, forest)
    n = len(forest.trees[8].children)
    assert kmtree.refine(placed, forest, 1) and len(forest.trees[8].children) > n
    while kmtree.refine(placed := kmtree.put(df, forest), forest, 1):
        pass
    assert [s for leaf, s in forest.trees[8].sizes.items() if s > 60] and sum(forest.trees[8].sizes.values()) == 1500
    assert all(leaf in forest.trees[8].solid for leaf, s in forest.trees[8].sizes.items() if s > 60)
    rows = kmtree.search(df, F.col("vec_id") % 25 == 0, most_sampled=200).collect()
    found = sum(len({r.vec_id for r in rows if r.query_id == q} & set(brute_neighbours(x, q, np.arange(1500)))) for q in range(0, 1500, 25) if not 1000 <= q < 1200)
    assert found >= 0.93 * 52 * 10
    assert all(len([r for r in rows if r.query_id == q]) == 10 for q in range(0, 1500, 25))


def test_repeated_queries_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [9.0, 9.0]), *[(i, [1.0, float(i)]) for i in range(1, 30)], (100, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 4.0]), (200, [5.0])]
    got = kmtree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["rank"], r.vec_id) for r in got if r.query_id == 0] == [(i, i) for i in range(1, 11)]
    assert [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 100] == [(1, 7, 1.0)] and not [r for r in got if r.query_id == 200]


# --- near duplicates -------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").lower().split()
    return Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(texts, t=0.8):
    """Components by brute force over all pairs of bags of shingles."""
    sets = [shingles(x) for x in texts]
    label = list(range(len(texts)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and label[i] != label[j] and (a & b).total() >= t * (a | b).total() - 1e-9:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    moved = True
    return label


def copies(rng, n=70):
    base = [words(rng, 120) for _ in range(12)]
    out = [None, "", "short one", "Short  one", *base]
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return [*out, words(rng, 9000)]


def test_near_duplicates(spark):
    texts = [*copies(random.Random(7)), "la " * 30, "la " * 300, "la " * 290]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    kept = neardup.keep_first(docs.unionByName(docs.limit(5)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({i for i, c in enumerate(want) if i == c})
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(21)
    a, b = words(rng, 40), words(rng, 90)
    near = " ".join([*b.split()[:-1], "changed"])
    rows = spark.createDataFrame([(0, a), (1, a), (1, b), (5, b), (1, b), (6, near), (None, a), (None, near), (None, "")], "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in neardup.keep_first(rows).collect())
    assert kept == [(False, 0, a), (False, 1, b), (True, 0, "")]
    got = sorted(((r.class_id is None, r.class_id or 0, r.doc_id or 0, r.kept) for r in neardup.near_duplicates(rows).collect()))
    assert [(c, n) for c, n in Counter((x[0], x[1]) for x in got).items()] == [((False, 0), 3), ((False, 1), 5), ((True, 0), 1)]
    assert sum(x[3] for x in got) == 3


CLASHING = ["kept_id", "row", "gone_id", "gone_hash", "gone_spans", "scored_text_", "score", "copy_key", "text_hash", "bands", "class_id", "kept"]


def test_clashing_names(spark):
    text = words(random.Random(22), 60)
    docs = spark.createDataFrame([(i, text, *["x"] * len(CLASHING)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    want = [(0, text, *["x"] * len(CLASHING))]
    assert [tuple(r) for r in neardup.keep_first(docs).collect()] == want
    assert [tuple(r) for r in paragraphs.remove_repeats(docs).collect()] == want
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none, docs.columns, "toxic_").columns == [*docs.columns, "toxic_"]
    assert toxicity.score(docs, none, ["doc_id", "score"], "score").columns == ["doc_id", "score", "score"]


def test_repeated_lines_weigh_more():
    """Texts that differ in how often they say one thing are not near copies, though their sets of shingles are equal."""
    a, b = "la " * 30, "la " * 300
    assert classes([a, b]) == [0, 1]


def test_blocks_lose_no_link(spark, monkeypatch):
    texts = copies(random.Random(8), 120)
    monkeypatch.setattr(neardup, "REST_TILE", 2)
    monkeypatch.setattr(neardup, "ALL_TILE", 3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_rows_in_tiles_grow_with_the_group(spark, monkeypatch):
    """Near copies of a text that is not there, four words off: similar, but mostly not at the threshold."""
    rows = []
    verify = neardup._verify_blocks
    monkeypatch.setattr(neardup, "_verify_blocks", lambda cells, threshold: rows.append(cells.count()) or verify(cells, threshold))
    for n in (300, 1200):
        r = random.Random(5)
        texts = [[f"w{i}" for i in range(150)] for _ in range(n)]
        for i, t in enumerate(texts):
            for k in range(4):
                t[r.randrange(150)] = f"x{i}y{k}"
        neardup.near_duplicates(docs_of(spark, [" ".join(t) for t in texts]))
    assert rows[1] <= 5 * rows[0]


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(9)
    e = np.arange(1, 120, dtype=np.uint64)
    w = rng.random(len(e)) * 4
    v = w * rng.uniform(0.6, 1.4, len(e))
    true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    s = np.concatenate([dart_signatures([e, e], 256, [w, v], seed=k) for k in range(8)], axis=1)
    assert abs((s[0] == s[1]).mean() - true) < 0.04
    assert (dart_signatures([np.zeros(0, np.uint64)], 8, [np.zeros(0)]) == 0).all()
    assert [len(x[0]) for x in shingle_bags(["", "a", "a b c d e", "a b c d e f"])] == [0, 1, 1, 2]
    s, n, _, _ = next(shingle_bags(["la " * 20 + "a b c d e"]))
    assert n.max() == 16 and len(occurrences(s, n)) == n.sum() == 21


def test_components(spark):
    rng = random.Random(10)
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + rng.randrange(1, 9)) for _ in range(30)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and (got[100], got[95]) == (90, 90) and got[201 if 201 in got else 202] == 200


def test_paragraphs(spark):
    rng = random.Random(11)
    p, q, r = words(rng, 60), words(rng, 30), words(rng, 60)
    near = " ".join([*p.split()[:-1], "changed"])
    texts = [f"{p}\nshort line\n{r}", f"intro\n{near}\nshort line", f"{q}\n{q}", p, None, "", "short line"]
    docs = docs_of(spark, texts)
    rows = sorted((x.doc_id, x.word, x.n_words, x.first_doc_id, x.first_word, x.kept) for x in paragraphs.repeated_passages(docs).collect())
    assert rows == [(0, 0, 60, 0, 0, True), (1, 1, 60, 0, 0, False), (2, 0, 30, 2, 0, True), (2, 30, 30, 2, 0, False), (3, 0, 60, 0, 0, False)]
    left = {x.doc_id: x for x in paragraphs.remove_repeats(docs).collect()}
    assert {k: v.text for k, v in left.items()} == {0: texts[0], 1: "intro\nshort line", 2: q, 4: None, 5: "", 6: "short line"}
    assert left[1].n_chars == len("intro\nshort line")
    again = docs.unionByName(docs)
    assert {x.doc_id for x in paragraphs.repeated_passages(again).collect()} == {0, 1, 2, 3} and paragraphs.remove_repeats(again).count() == 2 * len(left)
    assert paragraphs.repeated_passages(docs.limit(0)).count() == 0 and paragraphs.remove_repeats(docs.limit(0)).count() == 0
    ids = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert paragraphs.repeated_passages(ids).count() == 0 and paragraphs.remove_repeats(ids).count() == len(texts)


def test_spans_of_one_text_never_touch_another(spark):
    rng = random.Random(23)
    a, u, v = (words(rng, 60, 10**9) for _ in range(3))
    rows = [(0, a), (1, a), (1, f"{u}\n{v}"), (1, f"{u}\n{v}"), (2, f"{v}\nend")]
    left = sorted((r.doc_id, r.text) for r in paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == [(0, a), (1, f"{u}\n{v}"), (1, f"{u}\n{v}"), (2, "end")]


def test_near_copies_inside_lines(spark):
    """Long sentences and long parts without marks are linked at a similarity of 0.8, not only if they are equal."""
    rng = random.Random(24)
    sentences = [words(rng, 60, 10**9) + "." for _ in range(8)]
    changed = [" ".join(["other", *s.split()[1:]]) for s in sentences]
    texts = [f"{words(rng, 9, 10**9)}. {s} {words(rng, 30, 10**9)}." for s in [*sentences, *changed]]
    left = {x.doc_id: x.text.split() for x in paragraphs.remove_repeats(docs_of(spark, texts)).collect()}
    assert all(left[i] == texts[i].split() for i in range(8))
    assert all("other" not in left[i] and len(left[i]) == 39 for i in range(8, 16)), {i: len(left[i]) for i in range(8, 16)}


def test_a_part_is_no_copy_of_its_own_line(spark):
    """Clean texts of one long line each, with and without marks, stay as they are."""
    rng = random.Random(26)
    texts = [" ".join(words(rng, rng.randrange(5, 60), 10**9) + "." * (i % 2) for _ in range(1 + i % 3)) for i in range(60)] + [words(rng, n, 10**9) for n in range(60, 140, 2)]
    assert paragraphs.repeated_passages(docs_of(spark, texts)).count() == 0
    # a chain of near copies from a part to its line: the line is the first place, and stays whole
    w = words(rng, 100, 10**9).split()
    chain = [" ".join(w[10:92]), " ".join(w)]
    left = {x.doc_id: x.text for x in paragraphs.remove_repeats(docs_of(spark, [chain[1], f"{chain[0]}\nend"])).collect()}
    assert left == {0: chain[1], 1: "end"}


def test_paragraph_pairs_by_brute_force(spark):
    """Whole lines against all pairs of lines: every similar pair is in one component, and only the first of each stays."""
    rng = random.Random(25)
    base = [words(rng, rng.randrange(40, 90)) for _ in range(15)]
    lines = []
    for _ in range(80):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        lines.append(" ".join(w))
    docs = docs_of(spark, lines)
    want = classes(lines)
    cut_at = {r.doc_id for r in paragraphs.repeated_passages(docs).filter("not kept").collect()}
    assert {i for i, c in enumerate(want) if c != i} <= cut_at
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs).collect()}
    assert all(i not in left for i, c in enumerate(want) if c != i)


def prose(rng, n):
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append(words(rng, rng.randrange(5, 14)) + ".")
    return " ".join(out)


def test_passages_inside_lines(spark):
    """Passages of over 50 words at any place of long lines are found, and nothing else is touched."""
    rng = random.Random(13)
    passages = [prose(rng, rng.randrange(51, 120)) for _ in range(30)]
    texts, holds = [], []
    for i in range(150):
        w = prose(rng, 300).split()
        if i < 90:
            at = rng.randrange(len(w))
            w[at:at] = passages[i % 30].split()
            holds.append(i)
        texts.append(" ".join(w))
    docs = docs_of(spark, texts)
    found = {}
    for x in paragraphs.repeated_passages(docs).collect():
        found.setdefault(x.doc_id, 0)
        found[x.doc_id] += x.n_words
    assert set(found) <= set(holds) and len(found) >= 0.97 * len(holds)
    left = {x.doc_id: x.text.split() for x in paragraphs.remove_repeats(docs).collect()}
    assert all(left[i] == texts[i].split() for i in range(150) if i < 30 or i >= 90)
    gone = sum(len(texts[i].split()) - len(left[i]) for i in range(30, 90))
    assert gone >= 0.7 * sum(len(passages[i % 30].split()) for i in range(30, 90))


def test_passages_without_marks(spark):
    """Every run of equal words is found whole, without sentence marks, and runs of one word of any length too."""
    rng = random.Random(15)
    passages = [words(rng, 51, 10**9) for _ in range(20)] + [words(rng, 20, 10**9) for _ in range(10)]
    texts = [" ".join([words(rng, rng.randrange(20, 90), 10**9), passages[i % 30], words(rng, rng.randrange(20, 90), 10**9)]) for i in range(60)]
    own = [" ".join(t.split(p)) for t, p in zip(texts, passages * 2, strict=True)]
    texts += ["x1 x2 x3 " + "ha " * 70 + "x4", "y1 y2 " + "ha " * 43 + "y3 y4 y5"]
    left = {x.doc_id: x.text.split() for x in paragraphs.remove_repeats(docs_of(spark, texts)).collect()}
    assert all(left[i] == texts[i].split() for i in range(30))
    assert all(left[i] == own[i].split() for i in range(30, 60)), [(i, len(left[i]), len(own[i].split())) for i in range(30, 60) if left[i] != own[i].split()]
    assert left[61] == ["y1", "y2", "y3", "y4", "y5"] and left[60].count("ha") >= 11 and {"x1", "x2", "x3", "x4"} <= set(left[60])


def test_words_between_repeats_stay(spark):
    rng = random.Random(14)
    a, b = words(rng, 15), words(rng, 15)
    texts = [f"{a}\ndue{i} to{i} sum{i}\n{b}" for i in range(4)]
    left = {x.doc_id: x.text for x in paragraphs.remove_repeats(docs_of(spark, texts)).collect()}
    assert left[0] == texts[0] and all(f"due{i} to{i} sum{i}" in left[i] for i in range(4)), left
    assert all(len(left[i].split()) < 33 for i in range(1, 4)), left


# --- mixing, chat ----------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(0, 80)) for _ in range(400)] + [None, "", "x" * 50_000, "long " * 3000]
    sources = [rng.choice(["a", "b", "b", "b", "c", None, "é", "d"]) for _ in texts]
    docs = docs_of(spark, texts, sources)
    sized, plan = mixing.plan_mix(docs)
    rows = mixing.copies(sized, plan).collect()
    assert sorted((r.doc_id, r.n_copies) for r in rows) == sorted((r.doc_id, r.n_copies) for r in mixing.copies(*mixing.plan_mix(docs.repartition(3))).collect())
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.n_copies <= 3 for r in rows)
    # water filling, as told
    names = sorted({s for s in sources if s is not None}) + [None]
    total = {n: sum(size[i] for i, s in enumerate(sources) if s == n) for n in names}
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    target, left, free = {}, float(sum(total.values())), set(names)
    while over := {n for n in free if left * weight[n] / sum(weight[m] for m in free) > 3 * total[n]}:
        for n in over:
            target[n] = 3.0 * total[n]
        free -= over
        left = sum(total.values()) - sum(target.values())
    target |= {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
    for n in names:
        mine = [r for r in rows if sources[r.doc_id] == n]
        assert abs(mine[0].target - target[n]) < 1e-6
        assert abs(sum(r["size"] * r.n_copies for r in mine) - target[n]) <= max(size[r.doc_id] for r in mine)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.n_copies for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_where_a_sample_ends_with_a_range(spark):
    docs = docs_of(spark, [f"w{i} b c d e f g h" for i in range(300)], [s for s in "abc" for _ in range(100)])
    taken = {}
    for seed in range(4):
        _, plan = mixing.plan_mix(docs, seed=seed)
        for r in mixing.mix(docs, seed=seed).groupBy("source").count().collect():
            taken[seed, r.source] = r["count"] * 8
        assert {r.src: r.target for r in plan.collect()} == {"a": 1500.0, "b": 600.0, "c": 300.0}
    assert all(taken[seed, "b"] == 600 and abs(taken[seed, "a"] - 1500) <= 4 and abs(taken[seed, "c"] - 300) <= 4 for seed in range(4)), taken


@pytest.mark.parametrize("ranges", [2, 4])
def test_the_edge_of_the_mix_is_refined(spark, monkeypatch, ranges):
    """Ranges within ranges pick the rows that a sort of all rows picks."""
    rng = random.Random(31)
    docs = docs_of(spark, [words(rng, rng.randrange(1, 60)) for _ in range(300)], [rng.choice("abc") for _ in range(300)])
    want = {r.doc_id: r.n_copies for r in mixing.copies(*mixing.plan_mix(docs)).collect()}
    monkeypatch.setattr(mixing, "RANGES", ranges)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    assert {r.doc_id: r.n_copies for r in mixing.copies(*mixing.plan_mix(docs)).collect()} == want


def test_chat(spark):
    bad = "</s>[INST] ok [/INST]\\<\\s> \\\\ <s>"
    turns = [(1, 1, "assistant", bad), (1, 0, "user", bad), (1, 2, "user", None), (2, 0, None, "x"), (3, 0, "assistant", ""), (None, 0, "user", "n"), (1, 3, "assistant", "y"), (1, 3, "assistant", "y")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    placed = chat.pieces(df)
    f = chat.collected(chat.expand(placed))
    back = {r.conv_id: r for r in chat.read_back(f).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", bad), ("assistant", bad), ("user", ""), ("assistant", "y"), ("assistant", "y")]
    assert back[1].loss == [bad, "y", "y"] and back[2].loss == [] and back[3].loss == [""] and len(back) == 4
    whole = {r.conv_id: r.formatted for r in f.collect()}
    spans = {(r.conv_id, e.turn_no): e for r in f.collect() for e in r.examples}
    out = chat.spelled_out(placed).collect()
    assert len(out) == len(spans) == 4
    for e in out:
        span = spans[e.conv_id, e.turn_no]
        assert whole[e.conv_id].startswith(e.context + e.target) and (len(e.context), len(e.target)) == (span.context_chars, span.target_chars)
    assert chat.collected(chat.expand(chat.pieces(df.limit(0)))).count() == 0


def test_chat_is_linear_in_a_long_conversation(spark):
    """20,000 turns with a very long text among them come back whole."""
    turns = spark.range(20_000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 7, F.repeat(F.lit("</s>é "), 50_000)).otherwise(F.col("id").cast("string")).alias("text"))
    r = chat.read_back(chat.collected(chat.expand(chat.pieces(turns)))).first()
    assert len(r.turns) == 20_000 and r.turns[7].text == "</s>é " * 50_000 and r.loss == [t.text for t in r.turns if t.role == "assistant"]


def test_loss_text_comes_from_the_output_by_its_mask(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q\\[INST]"), (1, 1, "assistant", "a <s>b\\ c"), (1, 2, "user", "ü"), (1, 3, "assistant", "done</s>")], "conv_id long, turn long, role string, text string")
    made = chat.collected(chat.expand(chat.pieces(turns)))
    row = made.first()
    for e in row.examples:
        assert e.piece is None
        assert row.formatted[e.context_chars : e.context_chars + e.target_chars] == chat_escape({1: "a <s>b\\ c", 3: "done</s>"}[e.turn_no - 1])
    assert chat.read_back(made).first().loss == ["a <s>b\\ c", "done</s>"]
    moved = lambda by, more: made.withColumn("examples", F.transform("examples", lambda e: F.struct(e["turn_no"].alias("turn_no"), e["start"].alias("start"), (e["context_chars"] + by).alias("context_chars"), (e["target_chars"] + more).alias("target_chars"))))
    assert chat.read_back(moved(1, 0)).first().loss[0] != "a <s>b\\ c"
    assert chat.read_back(moved(0, -1)).first().loss == ["a <s>b\\ ", "done</s"]


def chat_escape(text):
    text = text.replace("\\", "\\\\")
    for s in chat.CONTROL:
        text = text.replace(s, s[0] + "\\" + s[1:])
    return text


def test_buckets_hold_only_sizes_that_can_be_similar_and_lose_no_pair(spark):
    from timedtext.llm.neardup import shared_buckets

    rows, pairs = [], set()
    for n in range(1, 400):  # two bags of a band each, the larger as large as 0.8 lets it be
        rows += [(2 * n, n + 4, [n]), (2 * n + 1, int(n / 0.8) + 4, [n])]
        pairs.add((2 * n, 2 * n + 1))
    rows += [(10_000 + n, 10 * n + 4, [n]) for n in range(1, 400)]  # ten times as large: never a link
    found = shared_buckets(spark.createDataFrame(rows, "id long, n_words int, bands array<long>"), 0.8).collect()
    members = {}
    for r in found:
        members.setdefault(r.bucket, set()).add(r.id)
    met = {(a, b) for some in members.values() for a in some for b in some if a < b}
    assert met == pairs
    assert all(r.first == min(members[r.bucket]) for r in found)


def test_repeated_keys_have_their_first_place(spark):
    rng = random.Random(5)
    rows = [(d, rng.randrange(2), [rng.randrange(40) if rng.random() < 0.5 else rng.getrandbits(62) - 2**61 for _ in range(n)], rng.sample(range(99), n)) for d in range(300) for n in [rng.randrange(6)]]
    rows += rows[:20] + [(999, 0, [7**20], [3])] * 2  # one place told twice is one place
    places = {}
    for d, t, keys, words_ in rows:
        for key, w in zip(keys, words_, strict=True):
            places.setdefault(key, []).append((d, t, w))
    df = spark.createDataFrame(rows, "d int, t long, k array<long>, w array<int>").repartition(7)
    got = {tuple(r) for r in repeats.repeated(df.select("k", "d", "t", "w"), "d", "t", "w").collect()}
    assert got == {(k, *min(x)) for k, x in places.items() if len(set(x)) > 1}
    assert sorted(r.key for r in repeats.repeated(df.select("k")).collect()) == sorted(k for k, x in places.items() if len(x) > 1)
    assert repeats.repeated(df.select("k", "d").limit(0), "d").count() == 0


def test_heavy_shingles_are_signed_in_few_steps(monkeypatch):
    steps, module = [], sys.modules[dart_signatures.__module__]
    mix = module.mix
    monkeypatch.setattr(module, "mix", lambda x: steps.append(1) or mix(x))
    signed = dart_signatures([np.array([5, 6], np.uint64), np.array([6], np.uint64)], 18, [np.array([3000, 1]), np.array([1])])
    assert (signed > 0).all() and len(steps) < 200
