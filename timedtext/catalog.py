"""All queries of the timed-text operators, by name, with the SQL that checks them.

The driver's tables stand in for transcripts: ``events`` are timed items of a user, ``conversations`` are
ordered lines, lines of ``documents`` are segments. For Japanese rules, events bring the lines of :data:`JA_LINES` and :data:`CUES`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text
from .operators import chunks, folds, intervals, islands, timing
from .plans import cues, metrics
from .sources import srt, transcripts

GAP_MS = 21_600_000
BUCKET = 300_000
DAY = 86_400_000


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user_id, kind, s, e): start and end in ms."""
    e = read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("s"), F.round(F.col("value") * 1000).cast("bigint").alias("len"))
    return e.select("event_id", "user_id", "kind", "s", (F.col("s") + F.greatest("len", F.lit(0))).alias("e"))


EV = "ev AS (SELECT event_id, user_id, event_type AS kind, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + greatest(CAST(round(value * 1000) AS BIGINT), 0) AS e FROM events)"


def kind(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(F.col("kind").isin(*names))


# Lines that the rules for Japanese text are put to, one of them for every event in turn: (text, no_speech_prob, gap_fill, what becomes of it)
JA_LINES = [
    ("ご視聴ありがとうございました。", 0.9, False, "phantom phrase"),
    ("ご視聴ありがとうございました。", 0.1, False, "kept"),
    ("シ", 0.0, True, "gap-fill fragment"),
    ("シ", 0.0, False, "kept"),
    ("まだ雨が降っている", 0.0, False, "kept"),
    (" まだ雨が降っている　", 0.0, False, "repeated line"),
    ("まだ雨が降っている", 0.0, False, "repeated line"),
    ("字幕作成者 テスト", 0.7, False, "phantom phrase"),
    ("チャンネル登録よろしくお願いします!", None, False, "kept"),
    ("、。", 0.9, True, "gap-fill fragment"),
]
# Cues that every event brings: (idx, t_ms, dur_ms, text), and the units they make, by hand: pieces, their shares of the cue, ends of sentences
CUES = [
    (0, 0, 3000, "ね。」や!!ま"),
    (1, 3000, 1000, "[拍手]"),
    (2, 4000, 2001, "𠮷田さんが来た。もう夜だ"),
    (3, 6100, 999, "なに？明日？！「いいね」"),
    (4, 9000, 3333, "本棚を動かす。二階へ。明日に。"),
    (5, 14100, 800, "  "),
    (6, 20000, 0, "はい"),
]
UNITS_BY_HAND = [
    (0, "ね。", 0, 3000, 0, 0),
    (1, "」や!", 857, 3000, 0, 0),
    (2, "!", 2143, 3000, 0, 0),
    (3, "ま𠮷田さんが来た。", 2571, 6001, 0, 2),
    (4, "もう夜だなに？", 5385, 7099, 2, 3),
    (5, "明日？", 6350, 7099, 3, 3),
    (6, "！", 6600, 7099, 3, 3),
    (7, "「いいね」本棚を動かす。", 6683, 12333, 3, 4),
    (8, "二階へ。", 10555, 12333, 4, 4),
    (9, "明日に。", 11444, 12333, 4, 4),
    (10, "はい", 20000, 20000, 6, 6),
]  # number, text, start, end, first and last cue


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list, names: str) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else _q(x) if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") AS v({names})"


# --- joins and metrics ---------------------------------------------------------------------------


def coverage_report(spark, d):
    e = events(spark, d).withColumn("chars", F.length("kind"))
    return metrics.coverage(kind(e, "click"), kind(e, "view"), ["user_id"])


COVERAGE_SQL = f"""WITH {EV}, r AS (SELECT * FROM ev WHERE kind = 'click'), c AS (SELECT * FROM ev WHERE kind = 'view'),
m AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = r.user_id AND r.s < c.e AND r.e > c.s)),
x AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE c.user_id = r.user_id AND r.s < c.e AND r.e > c.s))
SELECT (SELECT count(*) FROM r) AS n_reference, (SELECT coalesce(sum(length(kind)), 0)::BIGINT FROM r) AS reference_chars,
(SELECT count(*) FROM m) AS n_missed, (SELECT coalesce(sum(length(kind)), 0)::BIGINT FROM m) AS missed_chars, (SELECT count(*) FROM x) AS n_extra"""


def coverage_missed(spark, d):
    e = events(spark, d)
    return intervals.uncovered(kind(e, "click"), kind(e, "view"), ["user_id"]).select("event_id", "user_id", "s", "e")


def coverage_extra(spark, d):
    e = events(spark, d)
    return intervals.uncovered(kind(e, "view"), kind(e, "click"), ["user_id"]).select("event_id", "user_id", "s", "e")


def overlap_pairs(spark, d):
    e = events(spark, d)
    return intervals.overlap_join(kind(e, "click"), kind(e, "view"), ["user_id"], bucket=BUCKET).select(F.col("l_event_id").alias("click_id"), F.col("r_event_id").alias("view_id"))


def points_in_spans(spark, d):
    e = events(spark, d)
    spans = kind(e, "view").select("user_id", "s", F.col("e").alias("e"))
    return intervals.points_inside(kind(e, "click").select("event_id", "user_id", F.col("s").alias("at")), spans, ["user_id"], "at")


# --- islands -------------------------------------------------------------------------------------


def cue_gap_groups(spark, d):
    e = events(spark, d)
    g = islands.gap_groups(e, ["user_id"], "s", "e", GAP_MS, order=["s", "event_id"])
    return g.groupBy("user_id", "island").agg(F.min("s").alias("s"), F.max_by("e", F.struct("s", "event_id")).alias("e"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "event_id", "kind"))), lambda x: x["kind"]), "").alias("text"))


CUE_GAP_SQL = f"""WITH {EV}, l AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS pe FROM ev),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {GAP_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT user_id, island::BIGINT AS island, min(s) AS s, last(e ORDER BY s, event_id) AS e, count(*) AS n, string_agg(kind, '' ORDER BY s, event_id) AS text FROM g GROUP BY user_id, island"""


def _ranked(spark, d):
    e = events(spark, d)
    return e.withColumn("idx", (F.row_number().over(W.partitionBy("user_id").orderBy("s", "event_id")) - 1).cast("int"))


RANKED = EV + ", rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS idx FROM ev)"


def verdict_runs(spark, d):
    return islands.runs(_ranked(spark, d), ["user_id"], "idx", "kind").select("user_id", "first", "last", "direction", "length")


RUNS = RANKED + ", i AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id, kind ORDER BY idx) AS g FROM rk), runs AS (SELECT user_id, min(idx)::INT AS first, max(idx)::INT AS last, kind AS direction, count(*) AS length FROM i GROUP BY user_id, kind, g HAVING count(*) >= 2)"


def flag_margin(spark, d):
    r = _ranked(spark, d)
    n = r.groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    return islands.flag_margin(islands.runs(r, ["user_id"], "idx", "kind").join(n, "user_id"), ["user_id"], "n")


FLAG_SQL = f"""WITH {RUNS}, n AS (SELECT user_id, count(*)::INT AS n FROM rk GROUP BY user_id)
SELECT DISTINCT user_id, unnest(generate_series(greatest(0, first - 2), least(n - 1, last + 2)))::INT AS idx FROM runs JOIN n USING (user_id)"""


def repeat_collapse(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return islands.repeats(lines, ["doc_id"], "idx", "line").filter("repeated").select("doc_id", "idx", "line")


REPEAT_SQL = r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM l),
p AS (SELECT *, CASE WHEN lag(bare) OVER w IS NOT DISTINCT FROM bare AND lag(idx) OVER w IS NOT NULL THEN 0 ELSE 1 END AS st FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS i FROM p),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, i) AS n, row_number() OVER (PARTITION BY doc_id, i ORDER BY idx) AS k FROM g)
SELECT doc_id, idx::INT AS idx, line FROM r WHERE n >= 3 AND length(bare) >= 6 AND k > 1"""


def clamp_last_word(spark, d):
    g = islands.gap_groups(events(spark, d), ["user_id"], "s", "e", GAP_MS, order=["s", "event_id"])
    g = g.withColumn("pos", F.row_number().over(W.partitionBy("user_id", "island").orderBy("s", "event_id")))
    return islands.clamp_last(g, ["user_id", "island"], "pos", "s", "e", 1500).select("event_id", "island", "e")


CLAMP_SQL = f"""WITH {EV}, l AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS pe FROM ev),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {GAP_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT event_id, island::BIGINT AS island, CASE WHEN row_number() OVER (PARTITION BY user_id, island ORDER BY s DESC, event_id DESC) = 1 THEN least(e, s + 1500) ELSE e END AS e FROM g"""


# --- intervals -----------------------------------------------------------------------------------


def _speech(spark, d):
    """Clicks as words, views as speech stretches made disjoint by merging."""
    e = events(spark, d)
    speech = islands.stitch(kind(e, "view").select("user_id", F.col("s").alias("a"), (F.col("s") + DAY).alias("b")), ["user_id"], under=1)
    # a chain of overlapping stretches needs the largest end so far, which the next merge gives
    speech = intervals.merge_close(speech, ["user_id"], 0, 1)
    return speech, kind(e, "click").select("user_id", F.col("s").alias("a"), F.col("e").alias("b"))


SPEECH = EV + f""", sp0 AS (SELECT user_id, s AS a, s + {DAY} AS b FROM ev WHERE kind = 'view'),
sp1 AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a, b) < 1 THEN 0 ELSE 1 END AS st FROM sp0),
sp2 AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM sp1),
speech AS (SELECT user_id, min(a) AS a, max(b) AS b FROM sp2 GROUP BY user_id, g),
words AS (SELECT user_id, s AS a, e AS b FROM ev WHERE kind = 'click')"""
MARGIN = 3_600_000


def stitch_speech(spark, d):
    return _speech(spark, d)[0]


def find_holes(spark, d):
    speech, words = _speech(spark, d)
    return intervals.find_holes(speech, words, ["user_id"], F.lit(MARGIN), bucket=DAY).select("user_id", "a", "b")


HOLES = SPEECH + f""", j AS (SELECT p.user_id, p.a AS pa, p.b AS pb, w.a - {MARGIN} AS ws, w.b + {MARGIN} AS we FROM speech p LEFT JOIN words w ON w.user_id = p.user_id AND w.a - {MARGIN} < p.b AND w.b + {MARGIN} > p.a),
k AS (SELECT *, greatest(pa, coalesce(max(we) OVER (PARTITION BY user_id, pa ORDER BY ws, we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pa)) AS cur FROM j),
holes AS (SELECT user_id, cur AS a, ws AS b FROM k WHERE ws > cur
UNION ALL SELECT user_id, greatest(pa, coalesce(max(we), pa)) AS a, pb AS b FROM j GROUP BY user_id, pa, pb HAVING greatest(pa, coalesce(max(we), pa)) < pb)"""
LEAST_HOLE, MERGE = 7_200_000, 10_800_000


def merge_holes(spark, d):
    speech, words = _speech(spark, d)
    return intervals.merge_close(intervals.find_holes(speech, words, ["user_id"], F.lit(MARGIN), bucket=DAY), ["user_id"], LEAST_HOLE, MERGE).select("user_id", "a", "b")


MERGE_SQL = f"""WITH {HOLES}, l AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a, b) < {MERGE} THEN 0 ELSE 1 END AS st FROM holes WHERE b - a >= {LEAST_HOLE}),
g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM l)
SELECT user_id, min(a) AS a, last(b ORDER BY a, b) AS b FROM g GROUP BY user_id, i"""


def complement_gaps(spark, d):
    speech, _ = _speech(spark, d)
    ends = events(spark, d).groupBy("user_id").agg((F.max("e") + 2 * DAY).alias("end"))
    return intervals.complement(speech, ends, ["user_id"]).select("user_id", "a", "b")


GAPS = SPEECH + f""", ends AS (SELECT user_id, max(e) + {2 * DAY} AS fin FROM ev GROUP BY user_id),
gaps AS (SELECT * FROM (SELECT f.user_id, coalesce(lag(p.b) OVER (PARTITION BY f.user_id ORDER BY p.a, p.b), 0) AS a, coalesce(p.a, f.fin) AS b FROM ends f LEFT JOIN speech p USING (user_id)
UNION ALL SELECT user_id, max(p.b), any_value(fin) FROM speech p JOIN ends USING (user_id) GROUP BY user_id) WHERE b > a)"""


def choose_cut(spark, d):
    speech, _ = _speech(spark, d)
    e = events(spark, d)
    ends = e.groupBy("user_id").agg((F.max("e") + 2 * DAY).alias("end"))
    marks = e.groupBy("user_id").agg((F.min("s") + 10 * DAY).alias("mark"), F.min("s").alias("after"))
    return intervals.choose_cut(intervals.complement(speech, ends, ["user_id"]), marks, ["user_id"], 3 * DAY, 1000, 250).select("user_id", "mark", F.col("cut").cast("bigint").alias("cut"))


CUT_SQL = f"""WITH {GAPS}, marks AS (SELECT user_id, min(s) + {10 * DAY} AS mark, min(s) AS aft FROM ev GROUP BY user_id),
t AS (SELECT m.*, g.a, least(greatest(mark, g.a + least(250, (g.b - g.a) / 2)), g.b - least(250, (g.b - g.a) / 2)) AS t FROM marks m JOIN gaps g USING (user_id)),
ok AS (SELECT user_id, arg_min(t, (abs(t - mark), a)) AS t FROM t WHERE abs(t - mark) <= {3 * DAY} AND t > aft + 1000 GROUP BY user_id)
SELECT user_id, mark, CAST(trunc(coalesce(ok.t, mark)) AS BIGINT) AS cut FROM marks LEFT JOIN ok USING (user_id)"""


def pad_and_clip(spark, d):
    e = kind(events(spark, d), "purchase", "view").select("event_id", F.col("s").alias("a"), F.col("e").alias("b"))
    return intervals.pad_and_clip(e, 1000, F.lit(0), F.lit(10**13))


# --- timing, subtitles -----------------------------------------------------------------------------


def _lines(spark, d):
    """Conversations as timed units: a line starts where the texts before it, at 60 ms a character, end."""
    c = read(spark, d, "conversations")
    before = F.sum(F.length("text") * 60).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    rows = c.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("int").alias("idx"), F.col("text").alias("ja"), F.when(F.col("turn") % 5 == 3, "").otherwise(F.col("text")).alias("en"), F.coalesce(before, F.lit(0)).alias("start_ms"), "role")
    return rows.withColumn("end_ms", F.col("start_ms") + F.length("ja") * 50)


LINES = """ln AS (SELECT conv_id::VARCHAR AS file_id, turn::INT AS idx, text AS ja, CASE WHEN turn % 5 = 3 THEN '' ELSE text END AS en,
coalesce(sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms, role FROM conversations),
un AS (SELECT *, start_ms + length(ja) * 50 AS end_ms FROM ln)"""
SHOWN = LINES + r""", sh AS (SELECT *, lead(start_ms) OVER (PARTITION BY file_id ORDER BY idx) AS nx, regexp_replace(regexp_replace(en, '\s+', ' ', 'g'), '^ | $', '', 'g') AS sq FROM un WHERE regexp_replace(en, '^\s+|\s+$', '', 'g') <> ''),
w AS (SELECT *, greatest(greatest(end_ms, start_ms + 1)::DOUBLE, start_ms + least(greatest(1.0::DOUBLE, length(sq) / 17::DOUBLE) * 1000, 7000)) AS en0, nx - 83.0::DOUBLE AS lim FROM sh),
tm AS (SELECT *, round_even(greatest(CASE WHEN lim IS NULL THEN en0 WHEN nx - en0 < 250 THEN lim ELSE least(en0, lim) END, start_ms + 1), 0)::BIGINT AS se FROM w)"""


def display_times(spark, d):
    return timing.display_times(_lines(spark, d)).select("file_id", "idx", "show_start_ms", "show_end_ms")


TIMES_SQL = f"WITH {SHOWN} SELECT u.file_id, u.idx, tm.start_ms AS show_start_ms, tm.se AS show_end_ms FROM un u LEFT JOIN tm USING (file_id, idx)"


def jp_cue_stretch(spark, d):
    r = _ranked(spark, d).select(F.col("user_id").cast("string").alias("file_id"), "idx", F.col("s").alias("t_ms"), (F.col("e") - F.col("s")).alias("dur_ms"))
    return timing.stretch(r).select("file_id", "idx", "t_ms", "end_ms")


STRETCH_SQL = f"""WITH {RANKED} SELECT user_id::VARCHAR AS file_id, idx::INT AS idx, s AS t_ms,
greatest(least(greatest(e, s + 700), coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY idx), greatest(e, s + 700))), s + 1) AS end_ms FROM rk"""


def wrap_lines(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.wrap(F.col("text")).alias("body"))


WRAP = r"""list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(string_split(regexp_replace({c}, '\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: [w])),
lambda a, x: CASE WHEN len(a) > 0 AND length(a[-1]) + 1 + length(x[1]) <= 42 THEN list_append(a[:-2], a[-1] || ' ' || x[1]) ELSE list_append(a, x[1]) END)"""
BODY = "array_to_string(CASE WHEN len(ls) > 3 THEN list_append(ls[1:2], array_to_string(ls[3:], ' ')) ELSE ls END, chr(10))"
WRAP_SQL = f"SELECT conv_id, turn, {BODY} AS body FROM (SELECT *, {WRAP.format(c='text')} AS ls FROM conversations)"


def _stamp_sql(c: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', ({c}) // 3600000, ({c}) // 60000 % 60, ({c}) // 1000 % 60, ({c}) % 1000)"


def srt_render(spark, d):
    return srt.render_units(_lines(spark, d))


SRT_SQL = rf"""WITH {LINES}, sh AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS n, {WRAP.format(c='en')} AS ls FROM un WHERE regexp_replace(en, '^\s+|\s+$', '', 'g') <> '')
SELECT file_id, string_agg(n || chr(10) || {_stamp_sql('start_ms')} || ' --> ' || {_stamp_sql('greatest(end_ms, start_ms + 700)')} || chr(10) || {BODY}, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM sh GROUP BY file_id"""


def srt_parse(spark, d):
    files = srt.render_units(_lines(spark, d)).select("file_id", F.col("srt").alias("value"))
    return srt.parse(files)


PARSE_SQL = rf"""WITH {LINES}, sh AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS n, {WRAP.format(c='en')} AS ls FROM un WHERE regexp_replace(en, '^\s+|\s+$', '', 'g') <> '')
SELECT file_id, n::INT AS idx, start_ms AS start, greatest(end_ms, start_ms + 700) AS "end", {BODY} AS text FROM sh"""


def score_report(spark, d):
    r = _ranked(spark, d).select(F.col("user_id").cast("string").alias("file_id"), "idx", F.col("s").alias("start"), F.col("e").alias("end"), F.col("kind").alias("text"))
    return metrics.score(r)


SCORE_SQL = f"""WITH {RANKED}, x AS (SELECT *, (e - s) / 1000.0::DOUBLE AS sec, e > lead(s) OVER (PARTITION BY user_id ORDER BY idx) AS ov FROM rk)
SELECT user_id::VARCHAR AS file_id, count(*) AS cues, count(*) FILTER (sec < 1) AS under_1s, count(*) FILTER (sec > 7) AS over_7s, count(*) FILTER (ov) AS overlaps, count(*) FILTER (length(kind) / greatest(sec, 0.001) > 20) AS cps_over_20 FROM x GROUP BY user_id"""


def reference_report(spark, d):
    r = _ranked(spark, d)
    shown = kind(r, "view").select(F.col("user_id").cast("string").alias("file_id"), "idx", F.col("s").alias("start"), F.col("e").alias("end"))
    reference = kind(r, "click").select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("ref_id"), "s", "e")
    return metrics.against_reference(shown, reference)


REFERENCE_SQL = f"""WITH {RANKED}, c AS (SELECT * FROM rk WHERE kind = 'view'), r AS (SELECT * FROM rk WHERE kind = 'click' ),
g AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY idx), 0) AS a, s AS b FROM c UNION ALL SELECT user_id, arg_max(e, idx), {metrics.FOREVER} FROM c GROUP BY user_id),
m AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = r.user_id AND c.s < r.e AND c.e > r.s)),
t AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM g WHERE g.user_id = m.user_id AND g.b - g.a >= 10000 AND g.a <= m.s AND m.s < g.b))
SELECT n.user_id::VARCHAR AS file_id, n.n AS n_reference, coalesce(k.n, 0) AS n_missed, coalesce(z.n, 0)::BIGINT AS stranded_ms, printf('%d/%d (%d%%)', coalesce(k.n, 0), n.n, round_even(coalesce(k.n, 0) * 100 / n.n, 0)::INT) AS missed FROM (SELECT user_id, count(*) n FROM r GROUP BY 1) n
LEFT JOIN (SELECT user_id, count(*) n FROM m GROUP BY 1) k USING (user_id) LEFT JOIN (SELECT user_id, sum(e - s) n FROM t GROUP BY 1) z USING (user_id)"""


def verdict_histogram(spark, d):
    v = events(spark, d).withColumn("verdict", F.when(F.col("kind") == "click", "same").when(F.col("kind") == "view", "prev").when(F.col("kind") == "purchase", "next").otherwise("?"))
    return metrics.verdict_counts(v, ["user_id"])


HIST_SQL = f"""WITH {EV} SELECT user_id, count(*) FILTER (kind = 'click') AS same, count(*) FILTER (kind = 'view') AS prev, count(*) FILTER (kind = 'purchase') AS "next", 0::BIGINT AS none, count(*) FILTER (kind NOT IN ('click', 'view', 'purchase')) AS "?" FROM ev GROUP BY user_id"""


# --- folds, chunks -----------------------------------------------------------------------------------


def segment_units(spark, d):
    r = _ranked(spark, d)
    pieces = r.select(F.col("user_id").cast("string").alias("file_id"), "idx", F.col("idx").alias("cue_index"), F.col("kind").alias("text"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), (F.col("kind") == "purchase").alias("ends_sentence"))
    return folds.segment(pieces, GAP_MS, 24).select("file_id", "idx", "ja", "start_ms", "end_ms", F.size("cue_index").alias("n_cues"))


SEGMENT_SQL = f"""WITH RECURSIVE {RANKED}, f AS (
SELECT user_id, idx, 0::BIGINT AS unit, kind AS ja, s, e AS mx, kind = 'purchase' AS shut, 1 AS n FROM rk WHERE idx = 0
UNION ALL
SELECT r.user_id, r.idx, CASE WHEN c.new THEN f.unit + 1 ELSE f.unit END, CASE WHEN c.new THEN r.kind ELSE f.ja || r.kind END, CASE WHEN c.new THEN r.s ELSE f.s END,
CASE WHEN c.new THEN r.e ELSE greatest(f.mx, r.e) END, r.kind = 'purchase', CASE WHEN c.new THEN 1 ELSE f.n + 1 END
FROM f JOIN rk r ON r.user_id = f.user_id AND r.idx = f.idx + 1, LATERAL (SELECT f.shut OR r.s - f.mx >= {GAP_MS} OR length(f.ja) + length(r.kind) > 24 AS new) c)
SELECT user_id::VARCHAR AS file_id, unit::INT AS idx, last(ja ORDER BY idx) AS ja, last(s ORDER BY idx) AS start_ms, last(mx ORDER BY idx) AS end_ms, last(n ORDER BY idx)::INT AS n_cues FROM f GROUP BY user_id, unit"""


def _picked(rows: list, names: list[str], n) -> "F.Column":
    """The row of a fixed list whose number is ``n`` modulo its length, as a struct."""
    listed = F.array(*[F.struct(*[F.lit(x).cast("double" if name == "no_speech_prob" else "string" if isinstance(x, str) else "boolean" if isinstance(x, bool) else "bigint").alias(name) for name, x in zip(names, r, strict=False)]) for r in rows])
    return F.element_at(listed, (n % len(rows) + 1).cast("int"))


def sentence_units(spark, d):
    """Every event is seven cues, a hundred seconds after those of the event before."""
    cue = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(n).cast("bigint").alias("dur_ms"), F.lit(s).alias("ja")) for i, t, n, s in CUES])
    rows = _ranked(spark, d).select(F.col("user_id").cast("string").alias("file_id"), F.col("idx").alias("k"), F.explode(cue).alias("c"))
    segs = F.lit(None).cast("array<struct<text:string,t_ms:bigint>>")
    rows = rows.select("file_id", (F.col("k") * len(CUES) + F.col("c.i")).alias("idx"), (F.col("k") * 100_000 + F.col("c.t")).cast("bigint").alias("t_ms"), "c.dur_ms", "c.ja", segs.alias("segs"))
    units = cues.to_units(rows)
    return units.select("file_id", "idx", "ja", "start_ms", "end_ms", F.array_join(F.transform("cue_index", lambda k: k.cast("string")), ",").alias("cues"))


def chunks_context(spark, d):
    c = chunks.chunk(_lines(spark, d), 3, 2, 1)
    j = lambda n: F.array_join(n, "|").alias(n)
    return c.select("file_id", "chunk", "first_unit", j("before"), j("target"), j("after"))


CHUNK_SQL = f"""WITH {LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS pos FROM un), k AS (SELECT *, pos // 3 AS chunk FROM p)
SELECT file_id, chunk::INT AS chunk, min(pos)::INT AS first_unit,
coalesce((SELECT string_agg(ja, '|' ORDER BY pos) FROM p WHERE p.file_id = k.file_id AND p.pos BETWEEN k.chunk * 3 - 2 AND k.chunk * 3 - 1), '') AS before,
string_agg(ja, '|' ORDER BY pos) AS target,
coalesce((SELECT string_agg(ja, '|' ORDER BY pos) FROM p WHERE p.file_id = k.file_id AND p.pos BETWEEN k.chunk * 3 + 3 AND k.chunk * 3 + 3), '') AS after FROM k GROUP BY file_id, chunk"""


def budget_sample(spark, d):
    return folds.budget_sample(_lines(spark, d), ["file_id"], "idx", "ja", 1500).select("file_id", "idx", F.col("total").cast("bigint").alias("total"), "sampled")


BUDGET_SQL = f"""WITH {LINES}, t AS (SELECT *, length(ja) + 1 AS sz, sum(length(ja) + 1) OVER (PARTITION BY file_id) AS total, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS pos FROM un),
s AS (SELECT *, sum(sz) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM t WHERE pos % (CASE WHEN total <= 1500 THEN 1 ELSE greatest(1, floor(total / 1500.0 + 0.5)) END) = 0)
SELECT file_id, idx, total::BIGINT AS total, total > 1500 AS sampled FROM s WHERE run <= 1500"""


def glossary_merge(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_id"), F.get_json_object("props", "$.k").alias("term"), F.col("event_type").alias("rendering"))
    e = e.withColumn("name", (F.col("user_id") % 50).cast("string")).withColumn("pos", F.row_number().over(W.partitionBy("name").orderBy("event_id")).cast("int"))
    first = F.row_number().over(W.partitionBy("name", "term").orderBy("pos"))
    base = e.filter("event_id % 17 = 0").withColumn("k", first).filter("k = 1")
    return folds.capped_merge(base, e.filter("event_id % 17 != 0"), ["name"], 25).select("name", "term", "rendering")


GLOSSARY_SQL = """WITH e AS (SELECT (user_id % 50)::VARCHAR AS name, event_id, json_extract_string(props, '$.k') AS term, event_type AS rendering FROM events),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, term ORDER BY event_id) AS k FROM e WHERE event_id % 17 = 0) WHERE k = 1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, term ORDER BY event_id) AS k FROM e WHERE event_id % 17 <> 0 AND term IS NOT NULL AND trim(term) <> '') WHERE k = 1),
n AS (SELECT a.*, row_number() OVER (PARTITION BY a.name ORDER BY event_id) AS r FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.name = a.name AND b.term IS NOT DISTINCT FROM a.term)),
h AS (SELECT name, count(*) AS c FROM b GROUP BY name)
SELECT name, term, rendering FROM b UNION ALL SELECT n.name, n.term, n.rendering FROM n LEFT JOIN h USING (name) WHERE n.r <= 25 - coalesce(h.c, 0)"""


def plan_windows(spark, d):
    speech, _ = _speech(spark, d)
    e = events(spark, d)
    base = e.groupBy("user_id").agg(F.min("s").alias("t0"), F.max("e").alias("t1"))
    ends = base.select(F.col("user_id").cast("string").alias("file_id"), ((F.col("t1") - F.col("t0")) / 1000.0).alias("end"))
    spans = speech.join(base, "user_id").select(F.col("user_id").cast("string").alias("file_id"), ((F.col("a") - F.col("t0")) / 1000.0).alias("a"), (F.least("b", "t1") / 1000.0 - F.col("t0") / 1000.0).alias("b")).filter("a < b")
    return folds.plan_windows(spans, ends, 864_000.0, 86_400.0)


def _windows_sql(stretches: str, columns: str) -> str:
    """``stretches``: CTEs that end in sp (file_id, a, b) and fin (file_id, fin)."""
    t = "least(greatest(edge + 864000, g.a + least(0.25, (g.b - g.a) / 2)), g.b - least(0.25, (g.b - g.a) / 2))"
    return f"""WITH RECURSIVE {stretches},
g AS (SELECT file_id, coalesce(lag(b) OVER (PARTITION BY file_id ORDER BY a, b), 0.0::DOUBLE) AS a, a AS b FROM sp
UNION ALL SELECT file_id, last(b ORDER BY a, b), any_value(fin) FROM sp JOIN fin USING (file_id) GROUP BY file_id),
gl AS (SELECT file_id, list({{'a': a, 'b': b}} ORDER BY a) FILTER (b > a) AS gs FROM g GROUP BY file_id),
fl AS (SELECT fin.file_id, fin, CASE WHEN gl.file_id IS NULL THEN [{{'a': 0.0::DOUBLE, 'b': fin}}] ELSE coalesce(gs, []) END AS gs FROM fin LEFT JOIN gl USING (file_id)),
r AS (SELECT file_id, fin, gs, 0 AS idx, 0.0::DOUBLE AS edge FROM fl UNION ALL
SELECT file_id, fin, gs, idx + 1, round_even(coalesce(list_aggregate(list_transform(list_filter(gs, lambda g: abs({t} - edge - 864000) <= 86400 AND {t} > edge + 1), lambda g: {{'far': abs({t} - edge - 864000), 'a': g.a, 't': {t}}}), 'min').t, edge + 864000) * 1000, 0) / 1000.0::DOUBLE
FROM r WHERE edge + 864000 < fin - 216000),
w AS (SELECT file_id, idx, edge AS a, coalesce(lead(edge) OVER (PARTITION BY file_id ORDER BY idx), round_even(fin * 1000, 0) / 1000.0::DOUBLE) AS b FROM r)
SELECT {columns} FROM w"""


PLAN_SQL = _windows_sql(
    SPEECH
    + """, base AS (SELECT user_id, min(s) AS t0, max(e) AS t1 FROM ev GROUP BY user_id),
sp AS (SELECT * FROM (SELECT user_id::VARCHAR AS file_id, (a - t0) / 1000.0::DOUBLE AS a, least(b, t1) / 1000.0::DOUBLE - t0 / 1000.0::DOUBLE AS b FROM speech JOIN base USING (user_id)) WHERE a < b),
fin AS (SELECT user_id::VARCHAR AS file_id, (t1 - t0) / 1000.0::DOUBLE AS fin FROM base)""",
    "file_id, idx, a, b",
)
STRETCHES = (
    """t AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS t FROM events),
v AS (SELECT user_id, event_type, t - min(t) OVER (PARTITION BY user_id) AS a, max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id) AS total FROM t),
x AS (SELECT user_id::VARCHAR AS file_id, a, total, least(a + 21600, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), total)) AS b FROM v WHERE event_type = 'view' AND total > 0),
sp AS (SELECT file_id, a, b FROM x WHERE b > a), fin AS (SELECT file_id, max(total) AS fin FROM x WHERE b > a GROUP BY file_id)"""
)
STREAM_SQL = _windows_sql(STRETCHES, "file_id, a, b")


# --- scalars -------------------------------------------------------------------------------------------


def utf16_len(spark, d):
    """Texts with a character of two units after every e."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("e𝄞𠮷")).alias("s"))
    return rows.select("conv_id", "turn", text.utf16_length(F.col("s")).alias("n"))


def js_round(spark, d):
    """Quarters on both sides of 0, and what lies next to a half."""
    x = (F.col("event_id") % 1001 - 500) / 4
    return read(spark, d, "events").select("event_id", text.round_half_up(x).alias("n"), text.round_half_up(F.when(F.col("event_id") % 2 == 0, F.lit(0.49999999999999994)).otherwise(F.col("event_id") + 0.5)).alias("near"))


def srt_timestamp(spark, d):
    ms = F.col("event_id") * 77_777 - 500_000
    return read(spark, d, "events").select("event_id", text.timestamp(ms).alias("stamp"), text.clock(F.greatest(ms, F.lit(0)) / 1000).alias("clock"))


CLOCK_SQL = "CASE WHEN m >= 3600000 THEN printf('%d:%02d:%02d', m // 3600000, m // 60000 % 60, m // 1000 % 60) ELSE printf('%d:%02d', m // 60000, m // 1000 % 60) END"


def json_recover(spark, d):
    """Lines in replies of six kinds: plain, fenced, within prose, cut off, none and empty."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")
    rows = read(spark, d, "conversations").select("conv_id", "turn", said.alias("s"), ((F.col("conv_id") + F.col("turn")) % 6).alias("k"))
    plain, nested = F.concat(F.lit('{"1":"'), "s", F.lit('"}')), F.concat(F.lit('{"1":{"ja":"x","en":"'), "s", F.lit('"}}'))
    reply = F.when(F.col("k") == 0, plain).when(F.col("k") == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(F.col("k") == 2, F.concat(F.lit("Here: "), nested, F.lit(" done")))
    reply = reply.when(F.col("k") == 3, F.concat(F.lit('{"1":"'), "s")).when(F.col("k") == 4, F.lit("none")).otherwise("")
    found = rows.select("conv_id", "turn", F.to_json(text.recover_json(reply)).alias("v"))
    return found.select("conv_id", "turn", F.coalesce(F.get_json_object("v", "$.1.en"), F.get_json_object("v", "$.1")).alias("en"))


def phantom_filter(spark, d):
    """Every event is one of ten lines, in turn; ends of files cut the last ten short."""
    line = _picked(JA_LINES, ["text", "no_speech_prob", "gap_fill"], F.col("idx"))
    rows = _ranked(spark, d).select(F.col("user_id").cast("string").alias("file_id"), "idx", line.alias("line")).select("file_id", "idx", "line.*")
    kept, dropped = cues.clean(rows)
    return kept.select("file_id", "idx", F.lit("kept").alias("reason")).unionByName(dropped.select("file_id", "idx", "reason"))


# a line that comes again is dropped where it stands three times at least
PHANTOM_SQL = f"""WITH {RANKED}, n AS (SELECT user_id, max(idx) AS top FROM rk GROUP BY user_id)
SELECT user_id::VARCHAR AS file_id, idx::INT AS idx, CASE WHEN idx % 10 = 5 AND top = idx THEN 'kept' ELSE reason END AS reason FROM rk JOIN n USING (user_id) JOIN {_values([(k, r[3]) for k, r in enumerate(JA_LINES)], 'k, reason')} ON k = idx % 10"""


def media_kinds(spark, d):
    p = read(spark, d, "events").select(F.concat(F.lit("/d/x."), "event_id", F.element_at(F.array(*[F.lit(x) for x in (".MP4", ".ja.json", ".mp3", ".txt", ".JA.JSON")]), (F.col("event_id") % 5 + 1).cast("int"))).alias("path"))
    return p.select("path", text.media_kind(F.col("path")).alias("kind"), text.stem(F.col("path")).alias("stem"))


MEDIA_SQL = """WITH p AS (SELECT '/d/x.' || event_id || ['.MP4', '.ja.json', '.mp3', '.txt', '.JA.JSON'][event_id % 5 + 1] AS path, event_id FROM events)
SELECT path, CASE event_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'transcript' WHEN 2 THEN 'audio' END AS kind,
'x.' || event_id || CASE event_id % 5 WHEN 4 THEN '.JA' ELSE '' END AS stem FROM p"""


def sample_blocks(spark, d):
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 7).cast("string").alias("file_id"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("samples"))
    b = transcripts.reblock(e, 1000, 1000)
    return b.select("file_id", "block_no", "t0", F.size("samples").alias("n"), F.element_at("samples", 1).cast("double").alias("first"), F.element_at("samples", -1).cast("double").alias("last"))


BLOCK_SQL = """WITH s AS (SELECT (vec_id % 7)::VARCHAR AS file_id, vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding) AS x FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY vec_id, p) - 1 AS n FROM s)
SELECT file_id, n // 1000 AS block_no, (n // 1000)::DOUBLE AS t0, count(*)::INT AS n, first(x ORDER BY n)::DOUBLE AS first, last(x ORDER BY n)::DOUBLE AS last FROM n GROUP BY file_id, n // 1000"""


def result_documents(spark, d):
    return transcripts.result_document(_lines(spark, d)).select("file_id", F.sha2("document", 256).alias("digest"), F.length("document").alias("n"))


DOCUMENTS_SQL = f"""WITH {LINES}, t AS (SELECT file_id, to_json({{'title': file_id, 'source': NULL, 'backend': NULL, 'model': NULL, 'gap_ms': NULL, 'generated_at': NULL, 'glossary': NULL, 'units': list({{'t_ms': start_ms, 'end_ms': end_ms, 'ja': ja, 'en': nullif(en, '')}} ORDER BY idx)}})::VARCHAR AS doc FROM un GROUP BY file_id)
SELECT file_id, sha256(doc) AS digest, length(doc)::INT AS n FROM t"""


def stream_windows(spark, d):
    from .streaming.demo import windows_of_events

    return windows_of_events(spark, d)


def queries():
    names = """coverage_report coverage_missed coverage_extra overlap_pairs points_in_spans cue_gap_groups verdict_runs flag_margin repeat_collapse clamp_last_word
    stitch_speech find_holes merge_holes complement_gaps choose_cut pad_and_clip display_times jp_cue_stretch wrap_lines srt_render srt_parse score_report reference_report
    verdict_histogram segment_units sentence_units chunks_context budget_sample glossary_merge plan_windows utf16_len js_round srt_timestamp json_recover phantom_filter
    media_kinds sample_blocks result_documents stream_windows"""
    return {n: globals()[n] for n in names.split()}


_ANTI = "WITH {ev} SELECT event_id, user_id, s, e FROM ev r WHERE kind = '{a}' AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.kind = '{b}' AND c.user_id = r.user_id AND r.s < c.e AND r.e > c.s)"


def oracle_sql():
    return {
        "coverage_report": COVERAGE_SQL,
        "coverage_missed": _ANTI.format(ev=EV, a="click", b="view"),
        "coverage_extra": _ANTI.format(ev=EV, a="view", b="click"),
        "overlap_pairs": f"WITH {EV} SELECT l.event_id AS click_id, r.event_id AS view_id FROM ev l JOIN ev r ON l.user_id = r.user_id AND l.s < r.e AND l.e > r.s WHERE l.kind = 'click' AND r.kind = 'view'",
        "points_in_spans": f"WITH {EV} SELECT event_id, user_id, s AS at FROM ev p WHERE kind = 'click' AND EXISTS (SELECT 1 FROM ev v WHERE v.kind = 'view' AND v.user_id = p.user_id AND v.s <= p.s AND p.s < v.e)",
        "cue_gap_groups": CUE_GAP_SQL,
        "verdict_runs": f"WITH {RUNS} SELECT * FROM runs",
        "flag_margin": FLAG_SQL,
        "repeat_collapse": REPEAT_SQL,
        "clamp_last_word": CLAMP_SQL,
        "stitch_speech": f"WITH {SPEECH} SELECT user_id, a, b FROM speech",
        "find_holes": f"WITH {HOLES} SELECT user_id, a, b FROM holes",
        "merge_holes": MERGE_SQL,
        "complement_gaps": f"WITH {GAPS} SELECT user_id, a, b FROM gaps",
        "choose_cut": CUT_SQL,
        "pad_and_clip": f"WITH {EV} SELECT event_id, greatest(s - 1000, 0) AS a, least(e + 1000, 10000000000000) AS b FROM ev WHERE kind IN ('purchase', 'view')",
        "display_times": TIMES_SQL,
        "jp_cue_stretch": STRETCH_SQL,
        "wrap_lines": WRAP_SQL,
        "srt_render": SRT_SQL,
        "srt_parse": PARSE_SQL,
        "score_report": SCORE_SQL,
        "reference_report": REFERENCE_SQL,
        "verdict_histogram": HIST_SQL,
        "segment_units": SEGMENT_SQL,
        "sentence_units": f"WITH {RANKED} SELECT user_id::VARCHAR AS file_id, (rk.idx * {len(UNITS_BY_HAND)} + k)::INT AS idx, ja, (rk.idx * 100000 + a)::BIGINT AS start_ms, (rk.idx * 100000 + b)::BIGINT AS end_ms, (rk.idx * {len(CUES)} + c1) || CASE WHEN c2 > c1 THEN ',' || (rk.idx * {len(CUES)} + c2) ELSE '' END AS cues FROM rk, {_values(UNITS_BY_HAND, 'k, ja, a, b, c1, c2')}",
        "chunks_context": CHUNK_SQL,
        "budget_sample": BUDGET_SQL,
        "glossary_merge": GLOSSARY_SQL,
        "utf16_len": r"SELECT conv_id, turn, (length(coalesce(text, '')) + 4 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', ''))) + length(regexp_replace(coalesce(text, ''), '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INT AS n FROM conversations",
        "js_round": "SELECT event_id, floor((event_id % 1001 - 500) / 4.0::DOUBLE + 0.5)::BIGINT AS n, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id + 1 END AS near FROM events",
        "srt_timestamp": f"SELECT event_id, {_stamp_sql('m')} AS stamp, {CLOCK_SQL} AS clock FROM (SELECT event_id, greatest(event_id * 77777 - 500000, 0) AS m FROM events)",
        "json_recover": "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 < 3 THEN regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g') END AS en FROM conversations",
        "phantom_filter": PHANTOM_SQL,
        "media_kinds": MEDIA_SQL,
        "sample_blocks": BLOCK_SQL,
        "result_documents": DOCUMENTS_SQL,
        "plan_windows": PLAN_SQL,
        "stream_windows": STREAM_SQL,
    }
