import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timedtext.operators import chunks, folds, intervals, islands, timing
from timedtext.plans import cues, metrics
from timedtext.sources import srt, transcripts

few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
spans = st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60)).map(lambda x: (x[0], x[0] + x[1])), max_size=25)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@few
@given(spans, spans)
def test_bucketed_overlap_join_is_the_nested_loop(spark, left, right):
    a = spark.createDataFrame([("k", i, s, e) for i, (s, e) in enumerate(left)], "k string, id int, s bigint, e bigint")
    b = spark.createDataFrame([("k", i, s, e) for i, (s, e) in enumerate(right)], "k string, id int, s bigint, e bigint")
    want = sorted((i, j) for i, (s, e) in enumerate(left) for j, (t, u) in enumerate(right) if s < u and e > t)
    assert rows(intervals.overlap_join(a, b, ["k"], bucket=50), "l_id", "r_id") == want
    lost = sorted((i,) for i in range(len(left)) if i not in {x for x, _ in want})
    assert rows(intervals.uncovered(a, b, ["k"]), "id") == lost


def test_holes_merge_and_complement(spark):
    speech = spark.createDataFrame([("f", 10.0, 20.0), ("f", 30.0, 31.0)], "file_id string, a double, b double")
    words = spark.createDataFrame([("f", 10.0, 12.0), ("f", 18.0, 19.8)], "file_id string, a double, b double")
    holes = intervals.find_holes(speech, words, ["file_id"], F.lit(0.5), bucket=60)
    assert rows(intervals.merge_close(holes, ["file_id"], 1.0, 2.0), "a", "b") == [(12.5, 17.5), (30.0, 31.0)]
    ends = spark.createDataFrame([("f", 40.0), ("g", 5.0)], "file_id string, end double")
    assert rows(intervals.complement(speech, ends, ["file_id"]), "file_id", "a", "b") == [("f", 0.0, 10.0), ("f", 20.0, 30.0), ("f", 31.0, 40.0), ("g", 0.0, 5.0)]
    gaps = spark.createDataFrame([("f", 100.0, 100.4), ("f", 90.0, 95.0)], "file_id string, a double, b double")
    marks = spark.createDataFrame([("f", 99.0, 0.0)], "file_id string, mark double, after double")
    assert rows(intervals.choose_cut(gaps, marks, ["file_id"], 60, 1, 0.25), "cut") == [(100.2,)]


def test_windows_have_no_tiny_tail(spark):
    speech = spark.createDataFrame([("f", 0.0, 595.0), ("f", 605.0, 1300.0)], "file_id string, a double, b double")
    ends = spark.createDataFrame([("f", 1300.0), ("g", 700.0)], "file_id string, end double")
    assert rows(folds.plan_windows(speech, ends, 600.0), "file_id", "a", "b") == [("f", 0.0, 600.0), ("f", 600.0, 1300.0), ("g", 0.0, 700.0)]


def test_runs_and_margins(spark):
    v = ["same", "prev", "prev", "same", "next", "?", "next", "next", "next"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(v)], "file_id string, idx int, verdict string")
    found = islands.runs(df, ["file_id"], "idx", "verdict", ["prev", "next"])
    assert rows(found, "first", "last", "direction") == [(1, 2, "prev"), (6, 8, "next")]
    flagged = islands.flag_margin(found.withColumn("n", F.lit(9)), ["file_id"], "n", 1)
    assert rows(flagged, "idx") == [(0,), (1,), (2,), (3,), (5,), (6,), (7,), (8,)]


def test_display_times(spark):
    units = [(0, 0, 400, "hi"), (1, 1100, 9000, "x" * 200), (2, 9600, 9700, ""), (3, 9600, 9700, "a"), (4, 10000, 12000, "bye")]
    df = spark.createDataFrame([("f", *u) for u in units], "file_id string, idx int, start_ms bigint, end_ms bigint, en string")
    assert rows(timing.display_times(df).fillna(-1), "idx", "show_start_ms", "show_end_ms") == [(0, 0, 1017), (1, 1100, 9000), (2, -1, -1), (3, 9600, 9917), (4, 10000, 12000)]


def test_long_groups_split_at_the_later_of_equal_pauses(spark):
    words = [("これはながい", 0.0, 2.0), ("はなしですね", 2.3, 4.0), ("つぎのはなし", 4.3, 8.0)]
    df = spark.createDataFrame([("f", i, w, s, e) for i, (w, s, e) in enumerate(words)], "file_id string, w int, word string, start double, end double")
    assert rows(folds.split_long(df, ["file_id"], "w"), "w", "part") == [(0, 0), (1, 0), (2, 1)]


def test_cues_from_segments(spark):
    ws = [(0.0, 0.5, " あ", 0.9), (0.6, 5.0, "い", 0.9), (7.0, 7.2, "う", 0.9)]
    data = [("f", 0, 0.0, 8.0, "あいう", 0.1, False, ws), ("f", 1, 9.0, 9.5, " plain ", 0.1, False, None)]
    df = spark.createDataFrame(data, "file_id string, idx int, start double, end double, text string, no_speech_prob double, gap_fill boolean, words array<struct<start:double,end:double,word:string,p:double>>")
    got, dropped = cues.to_transcript(df)
    assert rows(got, "idx", "t_ms", "dur_ms", "ja") == [(0, 0, 2100, "あい"), (1, 7000, 200, "う"), (2, 9000, 500, "plain")]
    assert dropped.count() == 0


def test_timed_sentences(spark):
    data = [("f", 0, 12500, 1500, "単語", [(" 単", 12500), ("語。あ", 12900)])]
    df = spark.createDataFrame(data, "file_id string, idx int, t_ms bigint, dur_ms bigint, ja string, segs array<struct<text:string,t_ms:bigint>>")
    assert rows(folds.to_pieces(df), "text", "start_ms", "end_ms") == [("あ", 12900, 14000), ("単語。", 12500, 12900)]


@few
@given(st.integers(0, 40))
def test_chunks_partition_units(spark, n):
    df = spark.createDataFrame([("f", i, f"u{i}") for i in range(n)], "file_id string, idx int, ja string")
    got = sorted(chunks.chunk(df, 5, 3, 2).collect(), key=lambda r: r["chunk"])
    assert [x for r in got for x in r["target"]] == [f"u{i}" for i in range(n)]
    for r in got:
        k = r["first_unit"]
        assert r["before"] == [f"u{i}" for i in range(max(0, k - 3), k)] and r["after"] == [f"u{i}" for i in range(k + 5, min(n, k + 7))]


def test_srt_round_trip(spark):
    lines = [("f", i, i * 1000, i * 1000 + 900, f"line {i} one two three") for i in range(5)] + [("f", 5, 9000, 9000, " ")]
    df = spark.createDataFrame(lines, "file_id string, idx int, start_ms bigint, end_ms bigint, en string")
    text = srt.render_units(df)
    back = srt.parse(text.select("file_id", F.col("srt").alias("value")))
    assert rows(back, "idx", "start", "end", "text") == [(i, i * 1000, i * 1000 + 900, f"line {i} one two three") for i in range(5)]


def test_capped_merge(spark):
    base = spark.createDataFrame([("g", "a", "1", 0)], "name string, term string, rendering string, pos int")
    added = spark.createDataFrame([("g", "a", "2", 0), ("g", " ", "x", 1), ("g", "b", None, 2), ("g", "c", "3", 3), ("g", "d", "4", 4)], "name string, term string, rendering string, pos int")
    assert rows(folds.capped_merge(base, added, ["name"], 2), "term", "rendering", "pos") == [("a", "1", 0), ("c", "3", 1)]


def test_reblock_and_blocks(spark):
    rng = random.Random(1)
    data = [[float(rng.randint(0, 9)) for _ in range(rng.randint(0, 7))] for _ in range(9)]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(data)], "file_id string, chunk int, samples array<float>")
    flat = [x for c in data for x in c]
    got = sorted(transcripts.reblock(df, 4, 4).collect(), key=lambda r: r["block_no"])
    assert [r["samples"] for r in got] == [flat[i : i + 4] for i in range(0, len(flat), 4)]
    assert spark.createDataFrame([(flat,)], "s array<float>").select(transcripts.blocks_of(F.col("s"), 4).alias("b")).first()["b"] == [flat[i : i + 4] for i in range(0, len(flat), 4)]


def test_reading_transcripts_and_folders(spark, tmp_path):
    (tmp_path / "a.ja.json").write_text('{"title":"t","source":"whisper x","cues":[{"t_ms":1,"dur_ms":2,"ja":"あ"}]}')
    (tmp_path / "b.ja.json").write_text("{broken")
    (tmp_path / "a.mp4").write_bytes(b"x")
    got, broken = transcripts.read_transcripts(spark, str(tmp_path / "*.ja.json"))
    assert rows(got, "file_id", "idx", "ja") == [("a.ja.json", 0, "あ")] and rows(broken, "file_id") == [("b.ja.json",)]
    assert rows(transcripts.scan_folder(spark, str(tmp_path)), "name", "kind") == [("a.mp4", "video"), ("b.ja.json", "transcript")]


def test_score(spark):
    df = spark.createDataFrame([("f", 0, 0, 500, "ab"), ("f", 1, 400, 9000, "c"), ("f", 2, 9000, 10000, "d" * 30)], "file_id string, idx int, start bigint, end bigint, text string")
    r = metrics.score(df).first()
    assert (r.cues, r.under_1s, r.over_7s, r.overlaps, r.cps_over_20) == (3, 1, 1, 1, 1)


def test_long_groups_by_brute_force(spark):
    """Against a plain search for the widest pause, over and over, on words of a line."""
    from timedtext import catalog_jobs

    def may_end(before, after):
        return bool(before.strip() and after.strip()) and (("ぁ" <= before.strip()[-1] <= "ゟ") or before.strip()[-1] in "、。，．！？!?…」』)") and after.strip()[0] not in "ぁぃぅぇぉゃゅょっゎァィゥェォャュョッヮーゝゞ々"

    def places(ws, lo, hi):
        if hi - lo < 2 or ws[hi - 1].end - ws[lo].start <= 8.0:
            return []
        size = lambda a, b: len("".join(w.word for w in ws[a:b]).strip())
        ok = [(ws[k].start - ws[k - 1].end, k) for k in range(lo + 1, hi) if ws[k].start - ws[k - 1].end >= 0.15 and may_end(ws[k - 1].word, ws[k].word) and size(lo, k) >= 6 and size(k, hi) >= 6]
        return [] if not ok else [*places(ws, lo, max(ok)[1]), max(ok)[1], *places(ws, max(ok)[1], hi)]

    got = {}
    for r in catalog_jobs.split_cues(spark, "/root/testdata/sf0.001").collect():
        got.setdefault((r.file_id, r.turn), []).append(r)
    assert any(len({r.part for r in ws}) > 3 for ws in got.values())
    for ws in got.values():
        ws.sort(key=lambda r: r.w)
        cuts = places(ws, 0, len(ws))
        assert [r.part for r in ws] == [sum(c <= i for c in cuts) for i in range(len(ws))]


def test_sweeps_are_the_nested_loops(spark):
    rng = random.Random(9)
    spans_of = lambda n: [(i, s, s + rng.randrange(0, 9)) for i in range(n) for s in (rng.randrange(60),)]
    left, right = spans_of(60), spans_of(12)
    a, b = (spark.createDataFrame([("k", *r) for r in x], "k string, id int, s bigint, e bigint") for x in (left, right))
    assert rows(intervals.uncovered(a, b, ["k"]), "id") == [(i,) for i, s, e in left if not any(s < v and e > u for _, u, v in right)]
    assert rows(intervals.points_inside(a.select("k", "id", F.col("s").alias("at")), b, ["k"], "at"), "id") == [(i,) for i, s, _ in left if any(u <= s < v for _, u, v in right)]
