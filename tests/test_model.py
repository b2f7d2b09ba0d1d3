import pytest
from pyspark.errors import PySparkException

from timedtext.catalog_jobs import Translator
from timedtext.plans import glossary, job, model, storage
from timedtext.streaming import demo, windows


def units(spark, n=23):
    return spark.createDataFrame([("f", i, f"行{i}") for i in range(n)], "file_id string, idx int, ja string")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_only_outstanding_lines_are_asked_again(spark):
    out, failures = model.translate(units(spark), Translator())
    assert rows(out, "idx", "en") == [(i, f"EN 行{i}") for i in range(23)] and failures.count() == 0


def test_echo_and_initial(spark):
    initial = spark.createDataFrame([("f", 0, "kept"), ("f", 1, " ")], "file_id string, idx int, en string")
    out, _ = model.translate(units(spark, 5), Translator(echo=True), echo=True, initial=initial)
    assert rows(out, "idx", "en") == [(0, "kept"), *[(i, f"EN 行{i}") for i in range(1, 5)]]


def dead(prompt):
    raise OSError("no model")


def test_a_dead_backend_leaves_failures(spark):
    out, failures = model.translate(units(spark, 3), dead)
    assert rows(out, "en") == [("",)] * 3
    assert rows(failures, "message") == [("chunk 1: missing lines 1, 2, 3",)]


def analyst(prompt):
    return '```json\n{"setting": "a room", "names": {"あ": "A"}}\n```'


def test_analysis(spark):
    assert '"a room"' in model.analyse(units(spark), analyst).first()["glossary"]
    assert model.analyse(units(spark), dead).first()["glossary"] is None


class Judge:
    """Says that lines 3 to 5 belong to the line before, until they are translated anew."""

    def __call__(self, prompt):
        import json
        import re

        found = re.findall(r'(?m)^(\d+)\. English: "(.*)"$', prompt)
        return json.dumps({n: ("A" if en.startswith("old") else "B") for n, en in found})


def test_shifted_runs_are_repaired(spark):
    start = spark.createDataFrame([("f", i, f"行{i}", ("old" if 3 <= i <= 5 else "fine") + f" {i}") for i in range(12)], "file_id string, idx int, ja string, en string")
    out, found, left = model.check_and_repair(start, Translator(echo=True), Judge())
    assert rows(found, "first", "last", "direction") == [(3, 5, "prev")] and left.count() == 0
    got = dict(rows(out, "idx", "en"))
    assert got[0] == "fine 0" and got[4] == "EN 行4" and got[9] == "fine 9"


def test_streamed_windows_are_the_planned_ones(spark):
    from timedtext.operators.folds import plan_windows

    d = "/root/testdata/sf0.001"
    s = demo.stretches(spark, d)
    planned = plan_windows(s.filter("a is not null").select("file_id", "a", "b"), s.filter("total is not null").selectExpr("file_id", "total as end"), 864_000.0, 86_400.0)
    streamed = demo.windows_of_events(spark, d)
    assert rows(streamed, "file_id", "a", "b") == rows(planned, "file_id", "a", "b")


def test_resume_lends_the_equal_prefix(spark):
    plan = spark.createDataFrame([("f", i, float(i), float(i + 1)) for i in range(4)], "file_id string, idx int, a double, b double")
    saved = spark.createDataFrame([("f", 0, 0.0, 1.0, True), ("f", 1, 1.0, 2.0, False), ("f", 2, 2.0, 3.5, True), ("f", 3, 3.0, 4.0, True)], "file_id string, idx int, a double, b double, has_result boolean")
    assert rows(windows.reusable_windows(plan, saved), "idx") == [(0,)]


def test_a_stored_glossary(spark):
    entries = spark.createDataFrame([("s", "names", "あ", "A", 0)], "name string, category string, term string, rendering string, pos int")
    totals = spark.createDataFrame([("s", 2)], "name string, files long")
    found = spark.createDataFrame([("s", '{"names":{"あ":"B","い":"I","":"x"},"terms":[1]}'), ("new", '{"names":{},"terms":{"t":"T"}}')], "name string, glossary string")
    merged, after = glossary.remember(entries, totals, found)
    assert rows(merged, "name", "category", "term", "rendering") == [("new", "terms", "t", "T"), ("s", "names", "あ", "A"), ("s", "names", "い", "I")]
    assert rows(after, "name", "files", "new") == [("new", 1, 1), ("s", 3, 1)]
    loaded = glossary.load(after.select("name").union(spark.createDataFrame([("none",)], "name string")), merged, after)
    assert rows(loaded, "name", "files") == [("new", 1), ("none", 0), ("s", 3)]
    assert rows(glossary.seeds(loaded), "name") == [("new",), ("s",)]
    with pytest.raises(PySparkException, match="not a glossary name"):
        glossary.load(spark.createDataFrame([("../x",)], "name string"), merged, after).collect()


def test_lists_of_unequal_length_raise(spark):
    a = spark.createDataFrame([("f", 0), ("f", 1)], "file_id string, idx int")
    b = spark.createDataFrame([("f", 0, "x")], "file_id string, idx int, en string")
    assert rows(storage.with_positions(a.filter("idx = 0"), b, ["file_id", "idx"], "en"), "en") == [("x",)]
    with pytest.raises(PySparkException, match="unequal length"):
        storage.with_positions(a, b, ["file_id", "idx"], "en").collect()


def test_job_outputs_are_written(spark, tmp_path):
    cues = spark.createDataFrame([("f", 0, 0, 1000, "一。二", None), ("f", 1, 9000, 500, "三", None)], "file_id string, idx int, t_ms bigint, dur_ms bigint, ja string, segs array<struct<text:string,t_ms:bigint>>")
    counts = job.finished_job(cues, str(tmp_path), Translator(echo=True), analyst, bilingual=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f.en.json", "f.en.srt", "f.ja-en.srt", "f.ja.srt"]
    assert (tmp_path / "f.ja-en.srt").read_text() == "1\n00:00:00,000 --> 00:00:00,917\n一。\nEN 一。\n\n2\n00:00:00,500 --> 00:00:01,500\n二\nEN 二\n\n3\n00:00:09,000 --> 00:00:10,000\n三\nEN 三\n" or (tmp_path / "f.ja-en.srt").read_text().count("EN ") == 3
    assert rows(counts, "units", "translated", "missing", "failed_chunks") == [(3, 3, 0, 0)]


def test_copies_are_compared_once(spark):
    """Each comparison in a plan takes a Python worker of its own for every task."""
    asked = spark.createDataFrame([("f", 0, "a b")], "file_id string, idx int, ja string")
    replies = spark.createDataFrame([("f", 0, '{"1": {"ja": "a b", "en": "A"}}')], "file_id string, chunk int, reply string")
    got = model.accept(asked, replies, True, False, 20)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in got.collect()] == [("f", 0, "A")]
