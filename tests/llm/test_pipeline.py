"""The stages against plain Python, on a small corpus with every kind of trouble in it."""

import random

import corpus_pipeline
import numpy as np
import test_llm
from pyspark.sql import functions as F
from timedtext.llm import mixing, toxicity
from timedtext.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, toxicity_score string"


def corpus(rng):
    """(doc_id, text): prose, exact and near copies, a shared passage, toxic texts, and empty ones."""
    words = test_llm.words
    base = [words(rng, rng.randrange(60, 140), 10**9) for _ in range(40)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base[:8]]
    passage = words(rng, 60, 10**9)
    shared = [f"{words(rng, 70, 10**9)}\n{passage}\n{words(rng, 50, 10**9)}" for _ in range(5)]
    toxic = [words(rng, 40, 10**9) + " scoundrel vermin wretch" for _ in range(25)]
    texts = [*base, *near, base[3], base[3], *shared, *toxic, None, "", words(rng, 5000, 10**9)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)], passage


def test_every_stage_by_brute_force(spark, tmp_path):
    rng = random.Random(41)
    rows, passage = corpus(rng)
    by_id = dict(rows)
    is_toxic = {i: "scoundrel" in (t or "") for i, t in rows}
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3], len(t or ""), "x", "y") for i, t in rows], DOCS)
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int(b)) for i, b in is_toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    settled = lambda df: cut(df, "stage")

    clean = settled(stages["toxicity"](spark, docs, folder))
    left = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and left == {i: t for i, t in rows if not is_toxic[i]}

    first = settled(stages["near_dedup"](spark, clean, folder))
    ids = sorted(left)
    label = test_llm.classes([left[i] for i in ids])
    want = {ids[k] for k, c in enumerate(label) if c == k}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == want

    once = settled(stages["substring_dedup"](spark, first, folder))
    got = {r.doc_id: r.text for r in once.collect()}
    holders = sorted(i for i in want if passage in (by_id[i] or ""))
    expected = {i: by_id[i] if passage not in (by_id[i] or "") or i == holders[0] else by_id[i].replace(passage + "\n", "") for i in want}
    assert len(holders) == 5 and got == expected
    assert all(r.n_chars == len(r.text or "") for r in once.collect())

    mixed = settled(stages["mixing"](spark, once, folder))
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
        assert r.text == got[r.doc_id]
    size = {i: len((t or "").split()) for i, t in got.items()}
    total, weight = {s: sum(n for i, n in size.items() if "abc"[i % 3] == s) for s in "abc"}, {"a": 5, "b": 2, "c": 1}
    for s in "abc":
        target = min(3 * total[s], sum(total.values()) * weight[s] / 8)
        mine = sum(size[i] * n for i, n in taken.items() if "abc"[i % 3] == s)
        assert target == 3 * total[s] or abs(mine - target) <= max(size.values()) or any(3 * total[x] < sum(total.values()) * weight[x] / 8 for x in "abc")
    assert max(taken.values()) <= 3

    packed = stages["packing"](spark, mixed, folder).collect()
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append(r.length)
    encoder = test_llm.tokens.ChunkEncoder(test_llm.tokens.vocabulary(test_llm.tokens.BYTE_LEVEL), True)
    assert {i: sum(x) for i, x in pieces.items()} == {i: n * (len(encoder.encode([got[i] or ""])[0]) // 4 + 1) for i, n in taken.items()}
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048

    out = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.piece, r.length) for r in out.collect()) == sorted((r.doc_id, r.piece, r.length) for r in packed)


def test_an_empty_corpus(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_the_draw_by_brute_force(spark):
    """Pareto ranks recomputed row by row: in every source the lowest ranks are taken, up to the words that are missing."""
    rng = random.Random(42)
    docs = test_llm.docs_of(spark, [test_llm.words(rng, rng.randrange(1, 60)) for _ in range(300)], [rng.choice("aab") for _ in range(300)])
    sized, plan = mixing.plan_mix(docs)
    rows = mixing.copies(sized, plan).collect()
    rate = {r.src: r.rate for r in plan.collect()}
    for s in "ab":
        mine = [r for r in rows if r.src == s]
        for r in mine:
            assert abs(r.p - (min(3.0, rate[s] * r["size"] ** 0.25) - r.whole)) < 1e-9
        open_ = sorted((r for r in mine if r["rank"] is not None), key=lambda r: (r["rank"], r.doc_id))
        picked = [r.n_copies - r.whole for r in open_]
        assert picked == sorted(picked, reverse=True)
        missing = mine[0].target - sum(r.whole * r["size"] for r in mine)
        assert abs(sum(r["size"] for r, p in zip(open_, picked, strict=True) if p) - missing) <= max(r["size"] for r in mine)


def test_the_classifier_by_brute_force(spark):
    """Counts, ratios, kept n-grams and the regression recomputed from whole texts, and the scores that follow."""
    rng = random.Random(43)
    texts = [test_llm.words(rng, 30, 200) + (" vermin" if i % 5 == 0 else "") for i in range(150)]
    docs = test_llm.docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, keep=64, steps=50)
    y = np.array([float(i % 5 == 0) for i in range(150)])
    held = [set() for _ in texts]
    for doc, bucket in toxicity.grams(texts):
        for i, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            held[i].add(b)
    toxic, other = {}, {}
    for i, some in enumerate(held):
        for b in some:
            (toxic if y[i] else other)[b] = (toxic if y[i] else other).get(b, 0) + 1
    n, m, found = y.sum(), (1 - y).sum(), []
    for b in set(toxic) | set(other):
        p, q = toxic.get(b, 0), other.get(b, 0)
        if p + q >= 3:
            ratio = np.log((p + 0.5) / (n + 1)) - np.log((q + 0.5) / (m + 1))
            found.append((-abs(ratio) / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)), b, ratio))
    kept = sorted(found)[:64]
    at = {b: k for k, (_, b, _) in enumerate(kept)}
    assert {b for b in range(len(model.slot)) if model.slot[b] >= 0} == set(at)
    x = np.zeros((150, 64))
    for i, some in enumerate(held):
        for b in some & at.keys():
            x[i, at[b]] = kept[at[b]][2]
    share = np.where(y == 1, y.mean(), 1 - y.mean()) ** -toxicity.LEAN
    share /= share.sum()
    w, c, mo, v = np.zeros(64), 0.0, np.zeros(65), np.zeros(65)
    for t in range(1, 51):
        gap = (1 / (1 + np.exp(-(x @ w + c))) - y) * share
        g = np.append(x.T @ gap + 1e-4 * w, gap.sum())
        mo, v = 0.9 * mo + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.02 * (mo / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, c = w - step[:64], c - step[64]
    want = 1 / (1 + np.exp(-(x @ w + c)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert np.allclose([got[i] for i in range(150)], want, atol=1e-6)


def test_stages_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= ids, name
        docs = cut(out, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.filter("length > 2048 or length < 1").isEmpty() and {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert packed.filter(F.col("offset") + F.col("length") > 2048).isEmpty()


def test_entry_has_the_eleven():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
