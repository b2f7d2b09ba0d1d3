import random

import pytest
from pyspark.sql import functions as F

from timedtext.functions import matching, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("s", "n"), [("𠮷野家", 4), ("abc", 3), ("", 0), ("あ𝄞い", 4)])
def test_utf16_length(spark, s, n):
    assert one(spark, text.utf16_length(F.col("s")), s=s) == n


@pytest.mark.parametrize(("x", "n"), [(2.5, 3), (-2.5, -2), (0.49999999999999994, 0), (0.5, 1), (-0.4, 0)])
def test_halves_go_up(spark, x, n):
    assert one(spark, text.round_half_up(F.col("x")), x=x) == n


@pytest.mark.parametrize(("ms", "s"), [(0, "00:00:00,000"), (-9, "00:00:00,000"), (360_000_123, "100:00:00,123"), (61_001, "00:01:01,001")])
def test_timestamp(spark, ms, s):
    assert one(spark, text.timestamp(F.col("ms")), ms=ms) == s


def test_sentence_rules(spark):
    assert one(spark, text.ends_sentence(F.col("s")), s="行った。」 ") is True
    assert one(spark, text.ends_sentence(F.col("s")), s="行った。と") is False
    assert one(spark, text.split_sentences(F.col("s")), s="あ。」い!!う") == ["あ。", "」", "い!", "!", "う"]
    assert one(spark, text.is_tag_only(F.col("s")), s=" ［拍手］ ") is True
    assert one(spark, text.is_clause_break(F.col("a"), F.col("b")), a="けど", b="次") is True
    assert one(spark, text.is_clause_break(F.col("a"), F.col("b")), a="奥", b="深い") is False


@pytest.mark.parametrize(("reply", "en"), [('{"1":"a"}', "a"), ('```json\n{"1":"b"}\n```', "b"), ('see {"1":"c"} ok', "c"), ('{"1":"c', None), (None, None)])
def test_json_is_recovered(spark, reply, en):
    got = one(spark, F.get_json_object(F.to_json(text.recover_json(F.col("r").cast("string"))), "$.1"), r=reply)
    assert got == en


def test_wrap_keeps_the_rest_on_the_last_line(spark):
    body = one(spark, text.wrap(F.col("s")), s="word " * 60)
    lines = body.split("\n")
    assert len(lines) == 3 and len(lines[0]) <= 42 and len(lines[2]) > 42 and body.split() == ["word"] * 60
    assert one(spark, text.wrap(F.col("s")), s="  ") == ""


def test_template_values_are_not_expanded_again(spark):
    assert one(spark, text.fill("a ${x} b ${y}", {"x": F.lit("${y}"), "y": F.lit("2")})) == "a ${y} b 2"
    with pytest.raises(KeyError):
        text.fill("${missing}", {})


@pytest.mark.parametrize(("a", "b", "ok"), [("今日は、いい天気", "今日はいい天気。", True), ("ＡＢＣ", "ABC", True), ("あ", None, False), ("。", "、", True), ("あ", "", False), ("長い文章です", "別のこと", False)])
def test_echo(a, b, ok):
    assert matching.echoes(a, b) is ok


def test_media_kinds(spark):
    rows = spark.createDataFrame([("/a/B.MP4",), ("b.ja.json",), ("c.JA.JSON",), ("d.flac",), ("e",)], "p string")
    got = rows.select(text.media_kind(F.col("p")).alias("k"), text.stem(F.col("p")).alias("s")).collect()
    assert [(r.k, r.s) for r in got] == [("video", "B"), ("transcript", "b"), (None, "c.JA"), ("audio", "d"), (None, "e")]


def test_decimals_round_as_a_printout_does(spark):
    rng = random.Random(3)
    xs = [0.0625, 0.1875, 2.0005, 2.675, 1.0005, -0.0625, 12.3455, 0.0, 7.0, 1e6 + 0.0015, *[rng.random() * 10**k for k in range(6) for _ in range(80)], *[k / 2000 for k in range(300)], *[k / 1024 for k in range(300)]]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", text.round_decimals(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [round(x, 3) for x in xs]


def test_long_runs_of_marks_and_closers(spark):
    s = "あ" + "！" * 20 + "」" * 30 + "い。」「う」」。"
    assert one(spark, text.split_sentences(F.col("s")), s=s) == ["あ！", *["！"] * 19, *["」"] * 30, "い。", "」", "「う」」。", ""]
    assert one(spark, text.split_sentences(F.col("s")), s="」あ") == ["」あ"]


def test_normalising_and_echo_by_brute_force(spark):
    import difflib
    import unicodedata

    rng = random.Random(4)
    rows = [("".join(rng.choice("あいうえＡb、 。") for _ in range(rng.randrange(9))), "".join(rng.choice("あいうえAb、 。") for _ in range(rng.randrange(9)))) for _ in range(200)]
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKC", s) if not c.isspace() and c not in "、。，．！？!?「」『』…・〜ー~")
    want = [bare(a) == bare(b) or bool(bare(a) and bare(b) and difflib.SequenceMatcher(None, bare(a), bare(b)).ratio() >= 0.7) for a, b in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r.ok for r in df.select("i", matching.echo_matches(F.col("a"), F.col("b")).alias("ok")).orderBy("i").collect()] == want


def test_small_rules(spark):
    assert one(spark, text.valid_name(F.col("s")), s="série 1.b-c_") is True and one(spark, text.valid_name(F.col("s")), s="../x") is False
    assert one(spark, text.json_text(F.col("s")), s='a"é\n') == '"a\\"é\\n"'
    assert one(spark, text.json_pretty(F.array("a")), a=1) == "[ 1 ]" or "1" in one(spark, text.json_pretty(F.array("a")), a=1)
    assert one(spark, text.percent_done(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, text.iso_time(F.col("t").cast("timestamp")), t="2024-05-01 10:00:00") == "2024-05-01T10:00:00Z"
