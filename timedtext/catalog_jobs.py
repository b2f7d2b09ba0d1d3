"""Queries of the composed plans: whole jobs, model calls, gap filling, stores, queues and progress, with their SQL.

Models are injected functions, so these queries bring stand-ins of their own, whose answers depend on what
they are asked: the translator puts ``EN`` before a line and first leaves some lines out, the analyst counts
characters, the judge goes by how the English begins, and the recogniser hears two words in every clip.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import catalog as c
from .functions import matching, text
from .operators import folds
from .plans import cues, gaps, glossary, job, metrics, model, progress, recognition, resume, storage
from .sources import files, srt, transcripts, wav
from .streaming import demo, windows

# --- stand-ins for models -------------------------------------------------------------------------------


class Translator:
    """``EN <line>`` for every line, but for lines whose number is a multiple of ``drop`` in requests of more than three."""

    def __init__(self, echo: bool = False, drop: int = 7):
        self.echo, self.drop = echo, drop

    def __call__(self, prompt: str) -> str:
        body = prompt.split("Lines:\n", 1)[1].rsplit("\nExample: ", 1)[0]
        rows: list[list[str]] = []
        for line in body.split("\n"):
            n, sep, rest = line.partition(": ")
            if sep and n.isdigit():
                rows.append([n, rest])
            elif rows:
                rows[-1][1] += "\n" + line
        asked = {n: s for n, s in rows if len(rows) <= 3 or int(n) % self.drop}
        return "```json\n" + json.dumps({n: {"ja": s, "en": f"EN {s}"} if self.echo else f"EN {s}" for n, s in asked.items()}, ensure_ascii=False) + "\n```"


def analyst(prompt: str) -> str:
    """Something to say about texts with an even number of lines."""
    body = prompt.split("Text:\n", 1)[1]
    return json.dumps({"setting": f"{len(body)} characters" if body.count("\n") % 2 else " ", "names": {}})


def opening(prompt: str) -> str:
    """How long the first line is, which is told however long the text is."""
    return json.dumps({"setting": f"{len(prompt.split('Text:' + chr(10), 1)[1].split(chr(10), 1)[0])} characters", "names": {}})


def judge(prompt: str) -> str:
    """``old`` lines are the line before's, ``none`` lines nobody's, and ``skip`` lines get no answer."""
    found = re.findall(r'(?m)^(\d+)\. English: "(.*)"$', prompt)
    said = {"old": "A", "none": "none", "late": "C"}
    return "so: " + json.dumps({n: said.get(en.split(" ")[0], "B") for n, en in found if not en.startswith("skip")})


def recogniser(clips: DataFrame) -> DataFrame:
    words = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(w).alias("word"), F.lit(1.0).alias("p")) for a, b, w in ((0.5, 0.7, "pad"), (1.5, 2.0, "in"))])
    return clips.select("file_id", "clip", F.lit(0).alias("idx"), F.lit(0.5).alias("start"), F.lit(2.0).alias("end"), F.lit("padin").alias("text"), words.alias("words"))


# --- lines of conversations ------------------------------------------------------------------------------


def talk(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, turn, ja): conversations as lines without sentence marks, a thousand seconds apart."""
    rows = c.read(spark, d, "conversations")
    ja = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[!?。．！？]", ""), r"\s+", " "))
    return rows.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("int").alias("turn"), ja.alias("ja"))


def cues_of(spark: SparkSession, d: str) -> DataFrame:
    segs = F.lit(None).cast("array<struct<text:string,t_ms:bigint>>")
    return talk(spark, d).select("file_id", F.col("turn").alias("idx"), (F.col("turn") * 1_000_000).cast("bigint").alias("t_ms"), (F.length("ja") * 50).cast("bigint").alias("dur_ms"), "ja", segs.alias("segs"))


def lines_of(spark: SparkSession, d: str, en: Column) -> DataFrame:
    order = W.partitionBy("file_id").orderBy("turn")
    rows = talk(spark, d).filter("ja != ''").withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    return rows.select("file_id", "idx", "ja", F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"), en.alias("en"))


TALK = r"""j AS (SELECT conv_id::VARCHAR AS file_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[!?。．！？]', '', 'g'), '\s+', ' ', 'g')) AS ja FROM conversations),
un AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY turn) - 1)::INT AS idx, ja, 'EN ' || ja AS en, turn * 1000000 AS start_ms, turn * 1000000 + length(ja) * 50 AS end_ms FROM j WHERE ja <> '')"""
JOB = TALK + c.SHOWN[len(c.LINES) :]


NOON = "2024-01-01T12:00:00Z"


def _job(spark, d, **options):
    cues = cues_of(spark, d).withColumn("source", F.concat(F.lit("talk "), "file_id"))
    return job.subtitle_job(cues, Translator(echo=True), opening, bilingual=True, about=job.About("test", "m:8b", NOON), **options)


def job_lines(spark, d):
    done, _ = _job(spark, d)
    return done.units.select("file_id", "idx", "ja", "start_ms", "end_ms", "en")


def job_counts(spark, d):
    """The translator says nothing of even lines at the end, so chunks fail."""
    units = kept_units(spark, d)
    out, failures = model.translate(units, Stubborn())
    done = job.Run(out, units, failures)
    return done.counts().join(done.messages(), "file_id", "left").withColumn("messages", F.array_join("messages", "; "))


class Stubborn:
    """Never answers lines whose number is even."""

    def __call__(self, prompt: str) -> str:
        body = prompt.split("Lines:\n", 1)[1].rsplit("\nExample: ", 1)[0]
        return json.dumps({n: "EN " + s for n, s in re.findall(r"(?m)^(\d+): (.*)$", body) if int(n) % 2})


def kept_units(spark, d):
    return lines_of(spark, d, F.lit("")).drop("en")


COUNTS_SQL = f"""WITH {TALK}, m AS (SELECT file_id, idx // 20 AS chunk, string_agg(idx + 1, ', ' ORDER BY idx) AS lines FROM un WHERE (idx + 1) % 2 = 0 GROUP BY ALL),
f AS (SELECT file_id, count(*) AS n, string_agg('chunk ' || (chunk + 1) || ': missing lines ' || lines, '; ' ORDER BY chunk) AS messages FROM m GROUP BY file_id)
SELECT u.file_id, count(*) AS units, count(*) FILTER ((idx + 1) % 2 = 1) AS translated, count(*) FILTER ((idx + 1) % 2 = 0) AS missing, coalesce(any_value(n), 0) AS failed_chunks, any_value(messages) AS messages
FROM un u LEFT JOIN f USING (file_id) GROUP BY u.file_id"""


def job_srt(spark, d):
    _, found = _job(spark, d)
    parts = [df.select("file_id", F.lit(suffix).alias("suffix"), "srt") for suffix, df in found.items() if suffix.endswith("srt")]
    return metrics.joined_reports(*parts)


def _srt_sql(rows: str, end: str, body: str, start: str = "start_ms") -> str:
    return f"string_agg(n || chr(10) || {c._stamp_sql(start)} || ' --> ' || {c._stamp_sql(end)} || chr(10) || {body}, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM {rows} GROUP BY file_id"


JOB_SRT_SQL = rf"""WITH {JOB}, ws AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS n, {c.WRAP.format(c="en")} AS ls FROM tm),
k AS (SELECT file_id, ja, turn * 1000000 AS t, length(ja) * 50 AS dur, lead(turn * 1000000) OVER (PARTITION BY file_id ORDER BY turn) AS nx, turn FROM j),
kc AS (SELECT *, greatest(least(greatest(t + dur, t + 700), coalesce(nx, greatest(t + dur, t + 700))), t + 1) AS e, row_number() OVER (PARTITION BY file_id ORDER BY turn) AS n FROM k WHERE ja <> '')
SELECT file_id, 'en.srt' AS suffix, {_srt_sql("ws", "se", c.BODY)} UNION ALL SELECT file_id, 'ja-en.srt' AS suffix, {_srt_sql("ws", "se", "ja || chr(10) || " + c.BODY)}
UNION ALL SELECT file_id, 'ja.srt' AS suffix, {_srt_sql("kc", "e", "ja", "t")}"""


def job_documents(spark, d):
    _, found = _job(spark, d)
    return found["en.json"].select("file_id", F.sha2("document", 256).alias("digest"))


JOB_DOCUMENTS_SQL = f"""WITH {TALK}, g AS (SELECT file_id, json_object('names', json('{{}}'), 'setting', length(arg_min(ja, idx)) || ' characters') AS found, list({{'t_ms': start_ms, 'end_ms': end_ms, 'ja': ja, 'en': en}} ORDER BY idx) AS us FROM un GROUP BY file_id)
SELECT file_id, sha256(to_json({{'title': file_id, 'source': 'talk ' || file_id, 'backend': 'test', 'model': 'm:8b', 'gap_ms': 2000, 'generated_at': '{NOON}', 'glossary': found, 'units': us}})::VARCHAR) AS digest FROM g"""


def job_from_recogniser(spark, d):
    """Cues close together, with the recogniser's preset: units end with a cue of eight characters or more, or where they would grow too long."""
    rows = cues_of(spark, d).withColumn("ja", F.left("ja", F.lit(30))).withColumn("t_ms", (F.col("idx") * 1000).cast("bigint")).withColumn("dur_ms", F.lit(900).cast("bigint"))
    preset = text.source_preset(F.lit("whisper large"))
    options = spark.range(1).select(preset.alias("p")).select("p.*").first()
    return cues.to_units(rows, options["gap_ms"], cue_end_min_chars=options["cue_end_min_chars"], limit=4).select("file_id", "idx", "ja", "start_ms", "end_ms")


RECOGNISER_SQL = f"""WITH RECURSIVE {TALK}, q AS (SELECT file_id, left(ja, 30) AS ja, turn * 1000 AS s, turn * 1000 + 900 AS e, row_number() OVER (PARTITION BY file_id ORDER BY turn) AS k FROM j),
p AS (SELECT *, regexp_replace(ja, '^ +| +$', '', 'g') AS t, row_number() OVER (PARTITION BY file_id ORDER BY k) AS r FROM q WHERE k <= 4 AND trim(ja) <> ''),
f AS (SELECT file_id, r, 0 AS unit, t AS ja, s, e AS mx, length(t) >= 8 AS shut FROM p WHERE r = 1
UNION ALL SELECT p.file_id, p.r, CASE WHEN n.o THEN f.unit + 1 ELSE f.unit END, CASE WHEN n.o THEN p.t ELSE f.ja || p.t END, CASE WHEN n.o THEN p.s ELSE f.s END, CASE WHEN n.o THEN p.e ELSE greatest(f.mx, p.e) END,
length(CASE WHEN n.o THEN p.t ELSE f.ja || p.t END) >= 8 FROM f JOIN p ON p.file_id = f.file_id AND p.r = f.r + 1, LATERAL (SELECT f.shut OR p.s - f.mx >= 500 OR length(f.ja) + length(p.t) > 64 AS o) n)
SELECT file_id, unit::INT AS idx, last(ja ORDER BY r) AS ja, last(s ORDER BY r)::BIGINT AS start_ms, last(mx ORDER BY r)::BIGINT AS end_ms FROM f GROUP BY file_id, unit"""

# --- model calls -------------------------------------------------------------------------------------------


def translate_retry(spark, d):
    out, _ = model.translate(c._lines(spark, d).drop("en"), Translator())
    return out.select("file_id", "idx", "en")


TRANSLATE_SQL = rf"WITH {c.LINES} SELECT file_id, idx, regexp_replace('EN ' || ja, '\s+$', '') AS en FROM un"


def translate_echo(spark, d):
    """With copies of the source, and lines that are there already."""
    units = kept_units(spark, d)
    initial = units.filter("idx % 3 = 1").select("file_id", "idx", F.concat(F.lit("kept "), "ja").alias("en"))
    out, _ = model.translate(units, Translator(echo=True), echo=True, size=4, initial=initial)
    return out.select("file_id", "idx", "en")


ECHO_SQL = f"WITH {TALK} SELECT file_id, idx, CASE WHEN idx % 3 = 1 THEN 'kept ' || ja ELSE en END AS en FROM un"


def analysis(spark, d):
    found = model.analyse(kept_units(spark, d), analyst, budget=10**9)
    return found.select("file_id", F.get_json_object("glossary", "$.setting").alias("setting"))


ANALYSIS_SQL = f"WITH {TALK} SELECT file_id, CASE WHEN count(*) % 2 = 0 THEN (sum(length(ja)) + count(*) - 1)::BIGINT || ' characters' END AS setting FROM un GROUP BY file_id"


def resumed_translation(spark, d):
    """Every conversation is translated by a job that stops after two batches of four; a second one asks for what is left."""
    units = lines_of(spark, d, F.lit("")).drop("en")
    table = resume.checkpoint_table(spark, storage.shared_path(spark, "checkpoint"))
    seen: list[int] = []
    options = {"model": "m", "size": 4, "batches": 4}
    first = resume.translate_kept(units, Translator(echo=True), analyst, table, should_stop=lambda: len(seen) >= 2, on_progress=lambda stage, done, total: seen.append(done), **options)
    # files that the first job finished left the table, as their subtitles are there
    open_files = first.units.filter("en = ''").select("file_id").distinct()
    held = storage.kept(table.read().groupBy("file_id").agg(F.count_if(F.col("idx") == resume.GLOSSARY).alias("analysed")), "checkpoint-held")
    second = resume.translate_kept(units.join(open_files, "file_id", "left_semi"), Translator(echo=True), analyst, table, **options)
    ended = second.units.unionByName(first.units.join(open_files, "file_id", "left_anti"))
    asked = first.asked.withColumn("job", F.lit(1)).unionByName(second.asked.withColumn("job", F.lit(2))).groupBy("file_id", "idx").agg(F.count("*").alias("asked"), F.max("job").alias("job"))
    lines = ended.join(asked, ["file_id", "idx"], "left").join(held, "file_id", "left").na.fill(0, ["asked"])
    counts = lines.groupBy("file_id").agg(F.count("*").alias("lines"), F.sum("asked").alias("asked"), F.count_if(F.col("en") == F.concat(F.lit("EN "), "ja")).alias("right"), F.coalesce(F.max("analysed"), F.lit(1)).alias("analysed"))
    left = table.read().groupBy("file_id").agg(F.count("*").alias("rows_left"))
    # some were asked by the first job and some by the second
    both = asked.agg((F.min("job") == 1).alias("some_before"), (F.max("job") == 2).alias("some_after"))
    return counts.join(left, "file_id", "left").na.fill(0, ["rows_left"]).crossJoin(both)


RESUMED_SQL = f"WITH {TALK} SELECT file_id, count(*) AS lines, count(*) AS asked, count(*) AS \"right\", 1::BIGINT AS analysed, 0::BIGINT AS rows_left, true AS some_before, true AS some_after FROM un GROUP BY file_id"


def counting(prompt: str) -> str:
    """As many names, terms and corrections as the number of lines leaves modulo 4, 3 and 2."""
    n = prompt.split("Text:\n", 1)[1].count("\n") + 1
    some = lambda k: {f"w{i}": "x" for i in range(n % k)}
    return json.dumps({"setting": "s", "names": some(4), "terms": some(3), "asr_corrections": some(2)})


def analysis_counts(spark, d):
    return model.glossary_counts(model.analyse(kept_units(spark, d), counting, budget=10**9))


ANALYSIS_COUNTS_SQL = f"WITH {TALK} SELECT file_id, (count(*) % 4)::INT AS names, (count(*) % 3)::INT AS terms, (count(*) % 2)::INT AS asr_corrections FROM un GROUP BY file_id"


def judged_lines(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("EN ", "late ", "old ", "none ", "skip ")]), F.col("idx") % 5 + 1)
    return model.judge(lines_of(spark, d, F.when(F.col("idx") % 7 == 6, "").otherwise(F.concat(kind, "ja"))), judge)


JUDGED_SQL = f"WITH {TALK} SELECT file_id, idx, CASE WHEN idx % 7 = 6 THEN '?' ELSE ['same', 'next', 'prev', 'none', '?'][idx % 5 + 1] END AS verdict FROM un"


def _slipped(spark, d):
    return lines_of(spark, d, F.concat(F.when(F.col("idx").isin(2, 3), "old ").otherwise("first "), "ja"))


def repaired_lines(spark, d):
    out, _, left = model.check_and_repair(_slipped(spark, d), Translator(echo=True), judge)
    return out.select("file_id", "idx", "en").join(left.groupBy("file_id").agg(F.count("*").alias("left")), "file_id", "left").na.fill(0, ["left"])


REPAIRED_SQL = f"""WITH {TALK}, n AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM un)
SELECT file_id, idx, CASE WHEN n >= 4 AND idx <= 5 THEN en WHEN idx IN (2, 3) THEN 'old ' || ja ELSE 'first ' || ja END AS en, 0::BIGINT AS "left" FROM n"""


def align_report(spark, d):
    units = _slipped(spark, d)
    found = metrics.align_report(units, model.judge(units, judge))
    shifted = F.array_join(F.transform("shifted", lambda r: F.concat(r["first"], F.lit("-"), r["last"], F.lit(" "), r["direction"])), ", ")
    return found.withColumn("shifted", shifted)


ALIGN_SQL = f"""WITH {TALK}, n AS (SELECT file_id, count(*) AS n FROM un GROUP BY file_id)
SELECT file_id, n AS lines, n - greatest(0, least(n, 4) - 2) AS same, greatest(0, least(n, 4) - 2) AS prev, 0::BIGINT AS "next", 0::BIGINT AS none, 0::BIGINT AS "?", CASE WHEN n >= 4 THEN '2-3 prev' ELSE '' END AS shifted FROM n"""


def prompt_frames(spark, d):
    """What a request for outstanding lines holds: context that is there, the lines, and an example of the first two."""
    units = kept_units(spark, d)
    known = units.select("file_id", F.when(F.col("file_id").cast("long") % 3 == 0, F.concat(F.lit('{"setting":"'), "file_id", F.lit('"}'))).alias("glossary")).distinct()
    asked = model.requests_for(units.filter("idx % 2 = 1"), model.frames_of(units, 4), known, False, 4)
    lines = F.regexp_extract("prompt", r"(?s)\nLines:\n(.*)\nExample: ", 1)
    return asked.select("file_id", "chunk", F.col("prompt").contains("\nBefore:\n").alias("has_before"), F.col("prompt").contains("\nAfter:\n").alias("has_after"), F.regexp_extract("prompt", r"(?m)^Glossary: (.*)$", 1).alias("glossary"), lines.alias("lines"), F.regexp_extract("prompt", r"Example: (.*)$", 1).alias("example"))


PROMPT_SQL = f"""WITH {TALK}, o AS (SELECT *, idx // 4 AS chunk, max(idx) OVER (PARTITION BY file_id) AS top, row_number() OVER (PARTITION BY file_id, idx // 4 ORDER BY idx) AS r FROM un),
k AS (SELECT file_id, chunk, any_value(top) AS top, string_agg((idx + 1) || ': ' || ja, chr(10) ORDER BY idx) AS lines, string_agg('"' || (idx + 1) || '": "..."', ', ' ORDER BY idx) FILTER (rr <= 2) AS ex
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, chunk ORDER BY idx) AS rr FROM o WHERE idx % 2 = 1) GROUP BY file_id, chunk)
SELECT file_id, chunk::INT AS chunk, chunk > 0 AS has_before, top > chunk * 4 + 3 AS has_after, CASE WHEN file_id::BIGINT % 3 = 0 THEN '{{"setting":"' || file_id || '"}}' ELSE '' END AS glossary, lines, '{{' || ex || '}}' AS example FROM k"""

# --- recognition ---------------------------------------------------------------------------------------------


def _heard(spark, d):
    """(segments, speech, ends) of users in seconds from their first event: clicks are words, views are speech."""
    e = c.events(spark, d)
    base = e.groupBy(F.col("user_id").alias("user_id")).agg(F.min("s").alias("t0"), (F.max("s") + 2 * c.DAY).alias("t1"))
    speech, _ = c._speech(spark, d)
    second = lambda x: (F.col(x) - F.col("t0")) / 1000.0
    speech = speech.join(base, "user_id").select(F.col("user_id").cast("string").alias("file_id"), second("a").alias("a"), second("b").alias("b"))
    clicks = c.kind(e, "click").join(base, "user_id").select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("no"), second("s").alias("start"), second("e").alias("end"))
    idx = (F.row_number().over(W.partitionBy("file_id").orderBy("start", "no")) - 1).cast("int")
    word = F.array(F.struct("start", "end", F.lit("w").alias("word"), F.lit(1.0).alias("p")))
    segments = clicks.select("file_id", idx.alias("idx"), "start", "end", F.lit("w").alias("text"), word.alias("words"))
    ends = base.select(F.col("user_id").cast("string").alias("file_id"), second("t1").alias("end"))
    return segments, speech, ends


def _filled(spark, d):
    segments, speech, ends = _heard(spark, d)
    return gaps.fill_gaps(segments, speech, ends, recogniser, bucket=86_400, margin=c.MARGIN / 1000, least=c.LEAST_HOLE / 1000, merge=c.MERGE / 1000)


def gap_fill_segments(spark, d):
    return _filled(spark, d)[0].select("file_id", "idx", F.bround(F.col("start") * 1000).cast("bigint").alias("start_ms"), "text", F.coalesce("gap_fill", F.lit(False)).alias("gap_fill"))


def gap_fill_stats(spark, d):
    return _filled(spark, d)[1].select("file_id", "holes", F.bround(F.col("seconds") * 1000).cast("bigint").alias("ms"), "recovered")


MERGED = f"""{c.HOLES}, ml AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a, b) < {c.MERGE} THEN 0 ELSE 1 END AS st FROM holes WHERE b - a >= {c.LEAST_HOLE}),
mg AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM ml),
t0 AS (SELECT user_id, min(s) AS t0 FROM ev GROUP BY user_id),
mh AS (SELECT user_id, min(a) - any_value(t0) AS a, last(b ORDER BY a, b) - any_value(t0) AS b FROM mg JOIN t0 USING (user_id) GROUP BY user_id, i),
cl AS (SELECT *, greatest(a - 1000, 0) AS a0, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS clip FROM mh),
rec AS (SELECT user_id, clip, a0 + 500 AS w1, a0 + 700 > a - 200 AS k1, a0 + 1500 AS w2 FROM cl)"""
FILL_SQL = f"""WITH {MERGED}, u AS (SELECT e.user_id, e.s - t0 AS st, 0 AS pass, 0 AS clip, event_id AS no, 'w' AS text FROM ev e JOIN t0 USING (user_id) WHERE kind = 'click'
UNION ALL SELECT user_id, CASE WHEN k1 THEN w1 ELSE w2 END, 1, clip, 0, CASE WHEN k1 THEN 'padin' ELSE 'in' END FROM rec)
SELECT user_id::VARCHAR AS file_id, (row_number() OVER (PARTITION BY user_id ORDER BY st, pass, clip, no) - 1)::INT AS idx, st::BIGINT AS start_ms, text, pass = 1 AS gap_fill FROM u"""
FILL_STATS_SQL = f"WITH {MERGED} SELECT user_id::VARCHAR AS file_id, count(*) AS holes, sum(b - a)::BIGINT AS ms, count(*) AS recovered FROM cl GROUP BY user_id"


class Hearer:
    """Two words in every clip, a second and two after its start: a letter, and the clip's start in milliseconds."""

    def __init__(self, letter: str):
        self.letter = letter

    def __call__(self, clips: DataFrame) -> DataFrame:
        at = F.lpad(F.bround(F.col("a") * 1000).cast("long").cast("string"), 12, "0")
        word = lambda start, said: F.struct(F.lit(start).alias("start"), F.lit(start + 0.5).alias("end"), said.alias("word"), F.lit(1.0).alias("p"))
        words = F.array(word(1.0, F.lit(self.letter)), word(2.0, at))
        return clips.select("file_id", "clip", F.lit(0).alias("idx"), F.lit(1.0).alias("start"), F.lit(2.5).alias("end"), F.concat(F.lit(self.letter), at).alias("text"), F.lit(0.1).alias("no_speech_prob"), words.alias("words"))


WINDOW = {"window": 864_000.0, "search": 86_400.0, "bucket": 864_000}
FOLDERS = 256


def _speech_of(spark, d):
    """(speech, ends, keys) of users, as :mod:`timedtext.streaming.demo` has them."""
    rows = storage.kept(demo.stretches(spark, d), "stretches")
    ends = rows.filter("total is not null").select("file_id", F.col("total").alias("end"))
    return rows.filter("a is not null").select("file_id", "a", "b"), ends, ends.select("file_id", text.key_of(F.col("file_id"), F.col("end")).alias("key"))


def recognised_windows(spark, d):
    """Three windows of every user are heard by a run that then stops; a second run hears the rest and uses the three again."""
    speech, ends, keys = _speech_of(spark, d)
    table = recognition.window_table(spark, storage.shared_path(spark, "heard"))
    rounds: list[int] = []
    recognition.transcribe(speech, ends, Hearer("w"), table, keys, at_once=3, should_stop=lambda: len(rounds) >= 1, on_progress=lambda stage, done, total: rounds.append(done), **WINDOW)
    heard = recognition.transcribe(speech, ends, Hearer("x"), table, keys, at_once=20, **WINDOW)
    return heard.segments.join(heard.stats.select("file_id", "windows", "reused", "holes"), "file_id").select("file_id", "idx", "window", F.bround(F.col("start") * 1000).cast("long").alias("start_ms"), "text", F.coalesce("gap_fill", F.lit(False)).alias("gap_fill"), "windows", "reused", "holes")


# a window's two words leave no hole before 3000 ms; a second pass hears a second before each hole
HEARD = f"""{c.STRETCHES}, wn AS (SELECT file_id, idx, round_even(a * 1000, 0)::BIGINT AS a, round_even(b * 1000, 0)::BIGINT AS b FROM ({c._windows_sql(c.STRETCHES, "file_id, idx, a, b")})),
ms AS (SELECT file_id, round_even(a * 1000, 0)::BIGINT AS a, round_even(b * 1000, 0)::BIGINT AS b FROM sp),
h0 AS (SELECT wn.file_id, wn.idx, greatest(ms.a, wn.a + 3000) AS a, least(ms.b, wn.b) AS b FROM wn JOIN ms ON ms.file_id = wn.file_id AND ms.a < wn.b AND ms.b > wn.a),
h1 AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY file_id, idx ORDER BY a, b) < 2000 THEN 0 ELSE 1 END AS st FROM h0 WHERE b - a >= 1000),
h2 AS (SELECT *, sum(st) OVER (PARTITION BY file_id, idx ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM h1),
hl AS (SELECT file_id, idx, min(a) AS a FROM h2 GROUP BY file_id, idx, i),
sg AS (SELECT file_id, idx AS win, a + 1000 AS start_ms, LETTER || lpad(a::VARCHAR, 12, '0') AS text, false AS gap_fill FROM wn UNION ALL
SELECT file_id, idx, a, LETTER || lpad((a - 1000)::VARCHAR, 12, '0'), true FROM hl)"""
RECOGNISED_SQL = f"""WITH {HEARD.replace("LETTER", "CASE WHEN idx < 3 THEN 'w' ELSE 'x' END")}, nw AS (SELECT file_id, count(*) AS windows FROM wn GROUP BY file_id), nh AS (SELECT file_id, count(*) FILTER (idx >= 3) AS holes FROM hl GROUP BY file_id)
SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY win, start_ms) - 1)::INT AS idx, win::INT AS "window", start_ms, text, gap_fill, windows, least(windows, 3) AS reused, coalesce(holes, 0) AS holes FROM sg JOIN nw USING (file_id) LEFT JOIN nh USING (file_id)"""


def media_outputs(spark, d):
    """From speech to the files of a job, which are read back: subtitles as they are, and of the documents what they list."""
    speech, ends, keys = _speech_of(spark, d)
    heard = recognition.transcribe(speech, ends, Hearer("w"), recognition.window_table(spark, storage.shared_path(spark, "heard")), keys, at_once=20, **WINDOW)
    _, found = job.media_job(heard, ends, Translator(echo=True), analyst, "whisper test", job.About("test", "m:8b", NOON), bilingual=True)
    path = storage.shared_path(spark, "outputs")
    job.write_outputs(found, path, FOLDERS)
    read = files.read_files(spark, path, FOLDERS)
    read = read.select(F.regexp_extract("name", r"^([^.]*)\.", 1).alias("file_id"), F.regexp_extract("name", r"^[^.]*\.(.*)$", 1).alias("suffix"), "value")
    listed = lambda path, kind: F.from_json(F.get_json_object("value", path), kind)
    units = listed("$.units", "array<struct<t_ms:bigint,end_ms:bigint,ja:string,en:string>>")
    cue = listed("$.cues", "array<struct<t_ms:bigint,dur_ms:bigint,ja:string>>")
    segs = listed("$.segments", "array<struct<text:string,gap_fill:boolean>>")
    said = F.when(F.col("suffix") == "en.json", F.concat_ws("|", F.get_json_object("value", "$.model"), F.get_json_object("value", "$.gap_ms"), F.array_join(F.transform(units, lambda u: F.concat(u["t_ms"], F.lit(" "), u["end_ms"], F.lit(" "), u["en"])), "|")))
    said = said.when(F.col("suffix") == "ja.json", F.concat_ws("|", F.get_json_object("value", "$.source"), F.get_json_object("value", "$.cue_count"), F.array_join(F.transform(cue, lambda x: F.concat(x["t_ms"], F.lit(" "), x["dur_ms"], F.lit(" "), x["ja"])), "|")))
    said = said.when(F.col("suffix") == "whisper.json", F.array_join(F.transform(segs, lambda x: F.concat(x["text"], F.when(x["gap_fill"], "+").otherwise(""))), "|"))
    return read.select("file_id", "suffix", said.otherwise(F.col("value")).alias("value"))


_MEDIA = HEARD.replace("LETTER", "'w'") + """, un AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY win, start_ms) - 1)::INT AS idx, text AS ja, 'EN ' || text AS en, start_ms, start_ms + 1500 AS end_ms, gap_fill FROM sg)"""
MEDIA_OUTPUTS_SQL = rf"""WITH {_MEDIA}{c.SHOWN[len(c.LINES):]}, ws AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS n, {c.WRAP.format(c="en")} AS ls FROM tm),
kc AS (SELECT *, idx + 1 AS n, greatest(least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY file_id ORDER BY idx), end_ms)), start_ms + 1) AS e FROM un)
SELECT file_id, 'en.srt' AS suffix, {_srt_sql("ws", "se", c.BODY).replace("AS srt", "AS value")} UNION ALL SELECT file_id, 'ja-en.srt', {_srt_sql("ws", "se", "ja || chr(10) || " + c.BODY)} UNION ALL SELECT file_id, 'ja.srt', {_srt_sql("kc", "e", "ja")}
UNION ALL SELECT file_id, 'en.json', 'm:8b|500|' || string_agg(start_ms || ' ' || end_ms || ' ' || en, '|' ORDER BY idx) FROM un GROUP BY file_id
UNION ALL SELECT file_id, 'ja.json', 'whisper test|' || count(*) || '|' || string_agg(start_ms || ' 1500 ' || ja, '|' ORDER BY idx) FROM un GROUP BY file_id
UNION ALL SELECT file_id, 'whisper.json', string_agg(ja || CASE WHEN gap_fill THEN '+' ELSE '' END, '|' ORDER BY idx) FROM un GROUP BY file_id"""


def stream_blocks(spark, d):
    return demo.windows_of_blocks(spark, d)


LOUD = c.STRETCHES.replace("sp AS (SELECT file_id, a, b FROM x WHERE b > a), fin AS", "sp9 AS (SELECT file_id, a, b FROM x WHERE b > a), fin9 AS") + """,
k AS (SELECT DISTINCT file_id, unnest(range(ceil(a / 600)::BIGINT, floor(b / 600)::BIGINT)) AS k FROM sp9), ki AS (SELECT *, k - row_number() OVER (PARTITION BY file_id ORDER BY k) AS i FROM k),
sp AS (SELECT file_id, min(k) * 600.0::DOUBLE AS a, (max(k) + 1) * 600.0::DOUBLE AS b FROM ki GROUP BY file_id, i), fin AS (SELECT file_id, floor(fin / 600) * 600::DOUBLE AS fin FROM fin9 WHERE fin >= 600)"""
BLOCKS_SQL = f"""WITH {LOUD}, wn AS ({c._windows_sql(LOUD, "file_id, idx, a, b")})
SELECT wn.file_id, wn.idx, wn.a, wn.b, count(k.k)::VARCHAR AS text FROM wn LEFT JOIN k ON k.file_id = wn.file_id AND k.k >= round_even(wn.a / 600, 0) AND k.k < round_even(wn.b / 600, 0) GROUP BY wn.file_id, wn.idx, wn.a, wn.b"""


def cues_from_words(spark, d):
    """Every user's events as the words of one segment: groups at pauses of half an hour, whose last words are cut short."""
    e = c.events(spark, d)
    base = e.groupBy("user_id").agg(F.min("s").alias("t0"))
    words = e.join(base, "user_id").select("user_id", F.struct(F.col("s"), "event_id", ((F.col("s") - F.col("t0")) / 1000.0).alias("start"), ((F.col("e") - F.col("t0")) / 1000.0).alias("end"), F.col("kind").alias("word"), F.lit(1.0).alias("p")).alias("w"))
    each = words.groupBy("user_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    segments = each.select(F.col("user_id").cast("string").alias("file_id"), F.lit(0).alias("idx"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit("").alias("text"), F.transform("ws", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("word"), w["p"].alias("p"))).alias("words"))
    return cues.to_cues(segments, max_word_gap=1800.0, max_word_s=60.0, max_cue_s=1e12).select("file_id", "idx", "t_ms", "dur_ms", "ja")


CUES_SQL = f"""WITH {c.EV}, l AS (SELECT ev.*, t0, lag(e) OVER (PARTITION BY ev.user_id ORDER BY s, event_id) AS pe FROM ev JOIN (SELECT user_id, min(s) AS t0 FROM ev GROUP BY 1) USING (user_id)),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS i FROM l),
q AS (SELECT user_id, i, min(s - t0) AS t_ms, last(least(e, s + 60000) - t0 ORDER BY s, event_id) AS e, string_agg(kind, '' ORDER BY s, event_id) AS ja FROM g GROUP BY user_id, i)
SELECT user_id::VARCHAR AS file_id, (row_number() OVER (PARTITION BY user_id ORDER BY i) - 1)::INT AS idx, t_ms, greatest(1, e - t_ms) AS dur_ms, ja FROM q"""


def transcript_made(spark, d):
    """Segments without word times to the transcript: what becomes a cue, and what is dropped and why."""
    line = c._picked(c.JA_LINES, ["text", "no_speech_prob", "gap_fill"], F.col("idx"))
    rows = c._ranked(spark, d).select(F.col("user_id").cast("string").alias("file_id"), "idx", line.alias("line"))
    words = F.lit(None).cast("array<struct<start:double,end:double,word:string,p:double>>")
    segments = rows.select("file_id", "idx", (F.col("idx") * 2.0).alias("start"), (F.col("idx") * 2.0 + 1.5).alias("end"), "line.*", words.alias("words"))
    said, dropped = cues.to_transcript(segments)
    return said.select("file_id", "t_ms", "dur_ms", "ja", F.lit(None).cast("string").alias("reason")).unionByName(dropped.select("file_id", "t_ms", F.lit(None).cast("bigint").alias("dur_ms"), "ja", "reason"))


TRANSCRIPT_SQL = f"""WITH r AS ({c.PHANTOM_SQL}), t AS (SELECT r.*, v.ja FROM r JOIN {c._values([(k, x[0]) for k, x in enumerate(c.JA_LINES)], 'k, ja')} ON k = idx % 10)
SELECT file_id, (idx * 2000)::BIGINT AS t_ms, CASE WHEN reason = 'kept' THEN 1500::BIGINT END AS dur_ms, CASE WHEN reason = 'kept' THEN regexp_replace(ja, '^[ 　]+|[ 　]+$', '', 'g') ELSE ja END AS ja, nullif(reason, 'kept') AS reason FROM t"""


def pretty_json(spark, d):
    e = c.read(spark, d, "events").select("event_id", F.struct("event_id", F.concat(F.lit("é "), "event_type").alias("kind"), F.lit(None).cast("int").alias("none")).alias("v"))
    return e.select("event_id", text.json_pretty(F.col("v")).alias("json"))


PRETTY_SQL = """SELECT event_id, '{' || chr(10) || '  "event_id" : ' || event_id || ',' || chr(10) || '  "kind" : "é ' || event_type || '",' || chr(10) || '  "none" : null' || chr(10) || '}' AS json FROM events"""


def split_cues(spark, d):
    """Words of a line, of which every seventh is followed by a pause, in groups of at most eight seconds; tested against brute force."""
    rows = talk(spark, d).select("file_id", "turn", F.posexplode(F.split("ja", " ")).alias("w", "word"))
    start = F.col("w") * 0.5 + F.floor(F.col("w") / 7) * (0.2 + (F.col("w") % 3) * 0.1)
    words = rows.select("file_id", "turn", "w", F.concat("word", F.lit("、")).alias("word"), start.alias("start"), (start + 0.4).alias("end"))
    return folds.split_long(words, ["file_id", "turn"], "w", 8.0)


def timed_sentences(spark, d):
    """Sentences of texts whose times are known every seven characters."""
    rows = c.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("int").alias("idx"), (F.col("turn") * 100_000).cast("bigint").alias("t_ms"), F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[!?。．！？]", ""), r"[.\s]+", "。").alias("ja"))
    parts = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length("ja") / 7).cast("int")), lambda i: F.struct(F.substr(F.col("ja"), i * 7 + 1, F.lit(7)).alias("text"), (F.col("t_ms") + i * 100).alias("t_ms"))), lambda s: s["text"] != "")
    # a table, as transcripts are: the words made up here are not a part of what is asked
    held = storage.kept(rows.withColumn("dur_ms", F.lit(90_000).cast("bigint")).withColumn("segs", parts), "timed")
    return folds.to_pieces(held).select("file_id", "idx", "cue_index", "text", "start_ms", "end_ms", "ends_sentence")


TIMED_SQL = r"""WITH q AS (SELECT conv_id::VARCHAR AS file_id, turn, turn * 100000 AS t, regexp_replace(regexp_replace(coalesce(text, ''), '[!?。．！？]', '', 'g'), '[.\s]+', '。', 'g') AS ja FROM conversations),
x AS (SELECT *, regexp_extract_all(ja, '[^。]*。|[^。]+$') AS ps FROM q),
e AS (SELECT file_id, turn, t, length(ja) AS n, generate_subscripts(ps, 1) AS pos, unnest(ps) AS p FROM x),
b AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY file_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM e)
SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY turn, pos) - 1)::INT AS idx, turn::INT AS cue_index, p AS text, (t + o // 7 * 100)::BIGINT AS start_ms,
greatest(CASE WHEN o + length(p) >= n THEN t + 90000 ELSE t + (o + length(p)) // 7 * 100 END, t + o // 7 * 100 + 1)::BIGINT AS end_ms, p LIKE '%。' AS ends_sentence FROM b"""


def shifted_segments(spark, d):
    """Segments of three words moved by a part of a second, rounded to milliseconds, with the words in a span."""
    e = c.events(spark, d).select(F.col("event_id").cast("string").alias("file_id"), (F.col("event_id") % 1000 / 64.0).alias("t"))
    word = lambda k: F.struct((F.col("t") + k).alias("start"), (F.col("t") + k + 0.25).alias("end"), F.lit(str(k)).alias("word"), F.lit(1.0).alias("p"))
    segments = e.select("file_id", F.lit(0).alias("idx"), F.col("t").alias("start"), (F.col("t") + 2.25).alias("end"), F.lit("012").alias("text"), F.array(*[word(k) for k in range(3)]).alias("words"))
    return cues.shift(segments, 0.0625, 3.0, 9.0).select("file_id", "start", "end", "text")


SHIFT_SQL = """WITH w AS (SELECT event_id::VARCHAR AS file_id, event_id % 1000 / 64.0::DOUBLE + k + 0.0625::DOUBLE AS s, event_id % 1000 / 64.0::DOUBLE + k + 0.3125::DOUBLE AS e, k FROM events, range(3) r(k)),
m AS (SELECT file_id, k, round_even(s * 1000, 0) / 1000.0::DOUBLE AS s, round_even(e * 1000, 0) / 1000.0::DOUBLE AS e FROM w)
SELECT file_id, min(s) AS start, max(e) AS "end", string_agg(k, '' ORDER BY k) AS text FROM m WHERE e > 2.8::DOUBLE AND s < 9.2::DOUBLE GROUP BY file_id"""


def clipped_speech(spark, d):
    speech, _ = c._speech(spark, d)
    from .operators.intervals import clip

    return clip(speech, 1_705_000_000_000, 1_706_000_000_000)


CLIP_SQL = f"WITH {c.SPEECH} SELECT user_id, greatest(a, 1705000000000) AS a, least(b, 1706000000000) AS b FROM speech WHERE b > 1705000000000 AND a < 1706000000000"

# --- subtitles, transcripts, stores ---------------------------------------------------------------------------


def bilingual_srt(spark, d):
    return srt.render_units(c._lines(spark, d), original="ja")


BILINGUAL_SQL = rf"""WITH {c.LINES}, sh AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS n, {c.WRAP.format(c="en")} AS ls FROM un WHERE regexp_replace(en, '^\s+|\s+$', '', 'g') <> '')
SELECT file_id, {_srt_sql("sh", "greatest(end_ms, start_ms + 700)", "ja || chr(10) || " + c.BODY)}"""


def transcripts_read(spark, d):
    """Conversations written as one JSON file each, with a broken file among them, and read again."""
    path = storage.shared_path(spark, "transcripts")
    cue = F.struct(F.col("t_ms"), F.col("dur_ms"), F.col("ja"))
    docs = cues_of(spark, d).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", cue.alias("c")))).alias("cs"))
    docs = docs.select("file_id", F.to_json(F.struct(F.col("file_id").alias("title"), F.lit("whisper x").alias("source"), F.transform("cs", lambda x: x["c"]).alias("cues"))).alias("value"))
    broken = docs.limit(1).select(F.lit("broken").alias("file_id"), F.lit("{broken").alias("value"))
    docs.unionByName(broken).repartition(8, "file_id").write.partitionBy("file_id").text(path)
    read, bad = transcripts.read_transcripts(spark, f"{path}/*/*.txt")
    rows = read.select("source", "idx", "t_ms", "ja")
    return rows.unionByName(bad.select(F.lit("broken").alias("source"), F.lit(-1).alias("idx"), F.lit(0).cast("bigint").alias("t_ms"), F.lit("").alias("ja")))


READ_SQL = f"""WITH {TALK} SELECT 'whisper x' AS source, (row_number() OVER (PARTITION BY file_id ORDER BY turn) - 1)::INT AS idx, turn * 1000000 AS t_ms, ja FROM j
UNION ALL SELECT 'broken', -1, 0, ''"""


def glossary_store(spark, d):
    """Two files for every glossary: what the first brought wins, entries are capped, and blank ones refused."""
    e = c.read(spark, d, "events").select((F.col("user_id") % 40).cast("string").alias("name"), "event_id", F.get_json_object("props", "$.k").alias("term"), F.col("event_type").alias("rendering"))
    first = F.row_number().over(W.partitionBy("name", "term").orderBy("event_id"))
    base = e.filter("event_id % 19 = 0 and term is not null").withColumn("k", first).filter("k = 1").select("name", F.lit("names").alias("category"), "term", "rendering", (F.row_number().over(W.partitionBy("name").orderBy("event_id")) - 1).cast("int").alias("pos"))
    totals = base.select("name", F.lit(3).cast("bigint").alias("files")).distinct()
    more = e.filter("event_id % 19 != 0 and term is not null").withColumn("k", first).filter("k = 1").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("event_id", "term", "rendering"))).alias("x"))
    found = more.select("name", F.to_json(F.struct(F.map_from_entries(F.transform("x", lambda r: F.struct(r["term"], r["rendering"]))).alias("names"), F.create_map(F.lit(" "), F.lit("blank")).alias("terms"))).alias("glossary"))
    entries, after = glossary.remember(base, totals, found, 30)
    loaded = glossary.load(after.select("name"), entries, after)
    return loaded.join(after.select("name", "new"), "name").select("name", "files", "new", F.size("names").alias("n_names"), F.size("terms").alias("n_terms"), F.get(F.map_keys("names"), F.lit(0)).alias("oldest"))


STORE_SQL = """WITH e AS (SELECT (user_id % 40)::VARCHAR AS name, event_id, json_extract_string(props, '$.k') AS term FROM events),
b AS (SELECT name, term, min(event_id) AS id FROM e WHERE event_id % 19 = 0 AND term IS NOT NULL GROUP BY 1, 2), m AS (SELECT DISTINCT name, term FROM e WHERE event_id % 19 <> 0 AND term IS NOT NULL),
a AS (SELECT name, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.name = m.name AND b.term = m.term) GROUP BY name), h AS (SELECT name, count(*) AS n, arg_min(term, id) AS oldest FROM b GROUP BY name),
f AS (SELECT DISTINCT name FROM m)
SELECT name, ((CASE WHEN h.n IS NULL THEN 0 ELSE 3 END) + (CASE WHEN f.name IS NULL THEN 0 ELSE 1 END))::BIGINT AS files, (least(greatest(30 - coalesce(h.n, 0), 0), coalesce(a.n, 0)))::BIGINT AS new,
(coalesce(h.n, 0) + least(greatest(30 - coalesce(h.n, 0), 0), coalesce(a.n, 0)))::INT AS n_names, 0 AS n_terms, h.oldest FROM h LEFT JOIN a USING (name) LEFT JOIN f USING (name)"""


def told(prompt: str) -> str:
    """An analyst that says what it was told is known."""
    known = re.search(r"(?m)^Known: (.*)$", prompt)
    return json.dumps({"setting": known[1] if known else "nothing"})


def glossary_series(spark, d):
    """Two jobs of each series remember their files' names at once: the one that comes second finds the store changed and merges anew. A third job's analysis is told all names."""
    lines = kept_units(spark, d)
    files = lines.select("file_id").distinct().withColumn("name", (F.col("file_id").cast("long") % 7).cast("string")).withColumn("job", F.col("file_id").cast("long") % 2)
    first = files.groupBy("name", "job").agg(F.min(F.col("file_id").cast("long")).cast("string").alias("file_id"))
    said = lines.filter("idx = 0").join(first, "file_id").select("name", "job", "file_id", F.array_distinct(F.regexp_extract_all(F.lower("ja"), F.lit("[a-z]+"), 0)).alias("ws"))
    names = F.map_from_arrays("ws", F.transform("ws", lambda w: F.concat(w, F.lit(" of "), "file_id")))
    found = storage.kept(said.select("name", "job", F.to_json(F.struct(names.alias("names"))).alias("glossary")), "series-found")
    table = glossary.store(spark, storage.shared_path(spark, "series"))
    job_one, job_two = (found.filter(F.col("job") == k).drop("job") for k in (0, 1))
    change = table.change

    def late(rows_of, tries=20):
        """Job one has read the store, and job two changes it before job one does."""
        table.change = change
        asked = []

        def rows(held):
            asked.append(held)
            if len(asked) == 1:
                glossary.remember_in(table, job_two)
            return rows_of(held)

        return change(rows, tries)

    table.change = late
    glossary.remember_in(table, job_one)
    third = files.groupBy("name").agg(F.max(F.col("file_id").cast("long")).cast("string").alias("file_id"))
    units = lines.join(third, "file_id", "left_semi")
    heard = model.analyse(units, told, glossary.known_for(third, table))
    _, totals = glossary.in_store(table.read())
    return heard.join(third, "file_id").join(totals, "name").select("name", "files", F.get_json_object("glossary", "$.setting").alias("known"))


SERIES_SQL = f"""WITH {TALK}, f AS (SELECT DISTINCT file_id::BIGINT AS file_id, (file_id::BIGINT % 7)::VARCHAR AS name, file_id::BIGINT % 2 AS job FROM un), m AS (SELECT name, job, min(file_id) AS file_id FROM f GROUP BY name, job),
w0 AS (SELECT name, job, m.file_id, regexp_extract_all(lower(ja), '[a-z]+') AS ws FROM m JOIN un ON un.file_id::BIGINT = m.file_id AND idx = 0), w AS (SELECT name, job, file_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM w0),
t AS (SELECT name, job, file_id, term, min(p) AS p FROM w GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY name, term ORDER BY job DESC) AS k FROM t),
e AS (SELECT name, term || '":"' || term || ' of ' || file_id AS pair, row_number() OVER (PARTITION BY name ORDER BY job DESC, p) AS n FROM o WHERE k = 1),
nm AS (SELECT name, string_agg('"' || pair || '"', ',' ORDER BY n) AS names FROM e WHERE n <= 40 GROUP BY name), c AS (SELECT name, count(*) AS files FROM m GROUP BY name)
SELECT name, files, coalesce('{{"names":{{' || names || '}},"terms":{{}}}}', 'nothing') AS known FROM c LEFT JOIN nm USING (name)"""


def job_progress(spark, d):
    """Lines of conversations are read as a stream of four batches; what is observed goes into a table as (stage, step, done, total)."""
    root = storage.shared_path(spark, "observed")
    lines = c.read(spark, d, "conversations").select("conv_id", "turn").withColumn("part", F.col("conv_id") % 4)
    lines.repartition("part").write.partitionBy("part").parquet(f"{root}/in")
    table = progress.progress_table(spark, f"{root}/progress")
    listener = progress.Observed(progress.Progress(progress.into(table, "job"), least_s=0.0), {"read": lines.count()})
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("conv_id long, turn long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        stream.observe("read", F.count(F.lit(1)).alias("done")).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    steps = table.read()
    before = F.lag("done").over(W.partitionBy("job", "stage").orderBy("step"))
    rows = steps.withColumn("grew", F.coalesce(F.col("done") > before, F.lit(True)))
    return rows.groupBy("job", "stage").agg(F.count("*").alias("steps"), F.max("done").alias("done"), F.max("total").alias("total"), F.bool_and("grew").alias("grew"))


PROGRESS_SQL = "SELECT 'job' AS job, 'read' AS stage, count(DISTINCT conv_id % 4) AS steps, count(*)::DOUBLE AS done, count(*)::DOUBLE AS total, true AS grew FROM conversations"


def wav_blocks(spark, d):
    """Vectors as sound of seven files, which are written, and read again in blocks by several tasks, as a batch and as a stream."""
    # the product is a float, as in SQL: in doubles a half can fall to the other side
    e = c.read(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("f"), "vec_id", F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("int")).alias("x"))
    sound = e.groupBy("f").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda v: v["x"])).alias("x"))
    root = storage.shared_path(spark, "sound")
    files.write_files(sound.select(F.concat("f", F.lit(".wav")).alias("name"), wav.wav_of(F.col("x"), 1000).alias("value")), root)
    batch = wav.read_wav(spark, root, 0.5, 4000)
    heard = storage.shared_path(spark, "heard")
    wav.stream_wav(spark, root, 0.5, 4000).writeStream.format("parquet").option("checkpointLocation", f"{heard}/state").option("path", f"{heard}/out").trigger(once=True).start().awaitTermination()
    streamed = spark.read.schema(wav.SCHEMA).parquet(f"{heard}/out")
    row = lambda df, how: df.select("file_id", "block_no", F.lit(how).alias("how"), "t0", F.size("samples").alias("n"), F.bround(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) * 32768).cast("long").alias("sum"), "last")
    return row(batch, "batch").unionByName(row(streamed, "stream"))


WAV_SQL = """WITH s AS (SELECT vec_id % 7 AS f, vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding) AS x FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY vec_id, p) - 1 AS n FROM s),
b AS (SELECT f || '.wav' AS file_id, n // 500 AS block_no, count(*)::INT AS n, sum(round(x::FLOAT * 1000)::BIGINT)::BIGINT AS "sum" FROM n GROUP BY f, n // 500)
SELECT file_id, block_no, how, block_no * 0.5::DOUBLE AS t0, n, "sum", block_no = max(block_no) OVER (PARTITION BY file_id, how) AS "last" FROM b, (VALUES ('batch'), ('stream')) v(how)"""


def result_cache(spark, d):
    """Orders as wanted results and customers' earlier orders as kept ones: reusable where source and options are equal."""
    o = c.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("name"), (F.col("o_orderkey") % 5).alias("size"), (F.col("o_custkey") % 3).alias("mtime"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("model"))
    return transcripts.reusable(o.filter("k % 2 = 0"), o.filter("k % 2 = 1"), ["model"]).select("k")


CACHE_SQL = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS name, o_orderkey % 5 AS size, o_custkey % 3 AS mtime, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS model FROM orders)
SELECT k FROM o c WHERE k % 2 = 1 AND EXISTS (SELECT 1 FROM o w WHERE w.k % 2 = 0 AND w.name = c.name AND w.size = c.size AND w.mtime = c.mtime AND w.model IS NOT DISTINCT FROM c.model)"""


def resumed_windows(spark, d):
    """Windows of a saved run that may be used again: those before the first that differs."""
    r = c._ranked(spark, d).select(F.col("user_id").cast("string").alias("file_id"), "idx", (F.col("s") / 1000.0).alias("a"), (F.col("e") / 1000.0).alias("b"), "event_id")
    saved = r.withColumn("b", F.when(F.col("event_id") % 9 == 0, F.col("b") + 1).otherwise(F.col("b"))).withColumn("has_result", F.col("event_id") % 4 != 0)
    return windows.reusable_windows(r.drop("event_id"), saved.drop("event_id")).select("file_id", "idx")


RESUME_SQL = f"""WITH {c.RANKED}, f AS (SELECT user_id, min(idx) AS first FROM rk WHERE event_id % 9 = 0 GROUP BY user_id)
SELECT rk.user_id::VARCHAR AS file_id, idx::INT AS idx FROM rk LEFT JOIN f USING (user_id) WHERE idx < coalesce(first, 2000000000) AND event_id % 4 <> 0"""


def progress_table(spark, d):
    """Answers come in micro-batches and are appended; the newest of every key counts."""
    root = storage.shared_path(spark, "progress")
    e = c.read(spark, d, "events").select((F.col("user_id") % 30).alias("line"), F.col("event_id").alias("answer"), (F.col("event_id") % 3).alias("part"))
    for part in range(3):
        e.filter(F.col("part") == part).repartition("line").write.mode("append").parquet(f"{root}/in")
        newest = spark.readStream.schema(e.schema).parquet(f"{root}/in").groupBy("line").agg(F.max("answer").alias("answer"))
        windows.keep_progress(newest, f"{root}/out", f"{root}/state", mode="update").awaitTermination()
    return windows.latest(spark.read.parquet(f"{root}/out"), ["line"]).select("line", "answer")


def queue_state(spark, d):
    """Paths added to a queue that holds some already, and how many wait."""
    e = c.read(spark, d, "events").select(F.concat(F.lit("/m/"), (F.col("event_id") % 700).cast("string"), F.lit(".mp4")).alias("path"), F.col("event_id").alias("pos"), F.col("event_type").alias("status"))
    new = storage.new_in_queue(e.filter("pos % 5 != 0").drop("status"), e.filter("pos % 5 = 0").select("path").distinct())
    counts = storage.status_counts(e).select(F.col("status").alias("what"), F.col("n"))
    return counts.unionByName(new.agg(F.lit("new").alias("what"), F.count("*").alias("n"))).unionByName(new.agg(F.lit("first new").alias("what"), F.min("pos").alias("n")))


QUEUE_SQL = """WITH e AS (SELECT '/m/' || (event_id % 700) || '.mp4' AS path, event_id AS pos, event_type FROM events), n AS (SELECT path, min(pos) AS pos FROM e WHERE pos % 5 <> 0 AND path NOT IN (SELECT path FROM e WHERE pos % 5 = 0) GROUP BY path)
SELECT event_type AS what, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT 'new', count(*) FROM n UNION ALL SELECT 'first new', min(pos) FROM n"""


def folder_listing(spark, d):
    """Documents as files of two folders, media of three kinds, transcripts and notes; a transcript is left out beside media of its stem in its own folder alone."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("mp4", "ja.json", "FLAC", "md", "ja.json")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = c.read(spark, d, "documents").select((F.floor(F.col("doc_id") / 7) % 2).alias("folder"), F.concat(F.floor(F.col("doc_id") / 3).cast("string"), F.lit("."), suffix).alias("name"), F.lit("x").alias("value")).distinct()
    root = storage.shared_path(spark, "folders")
    for folder in range(2):
        files.write_files(rows.filter(F.col("folder") == folder), f"{root}/{folder}")
    found = transcripts.scan_folder(spark, f"{root}/*")
    return found.select(F.regexp_extract("path", r"/(\d)/[^/]*$", 1).alias("folder"), "name", "stem", "kind", "size")


FOLDER_SQL = """WITH f AS (SELECT DISTINCT (doc_id // 7 % 2)::VARCHAR AS folder, (doc_id // 3)::VARCHAR AS stem, ['mp4', 'ja.json', 'FLAC', 'md', 'ja.json'][doc_id % 5 + 1] AS suffix FROM documents),
k AS (SELECT *, CASE suffix WHEN 'mp4' THEN 'video' WHEN 'FLAC' THEN 'audio' WHEN 'ja.json' THEN 'transcript' END AS kind FROM f WHERE suffix <> 'md')
SELECT folder, stem || '.' || suffix AS name, stem, kind, 1::BIGINT AS size FROM k WHERE kind <> 'transcript' OR NOT EXISTS (SELECT 1 FROM k m WHERE m.folder = k.folder AND m.stem = k.stem AND m.kind <> 'transcript')"""


# --- reports and scalars --------------------------------------------------------------------------------------


def report_lines(spark, d):
    """The first two missed lines of every user, without one-character noise, beside its score."""
    e = c.events(spark, d).withColumn("text", F.when(F.col("event_id") % 10 == 0, " x ").otherwise(F.col("kind")))
    reference = metrics.without_noise(c.kind(e, "click"), "text")
    from .operators.intervals import uncovered

    missed = metrics.first_lines(uncovered(reference, c.kind(e, "view"), ["user_id"]), ["user_id"], ["s", "event_id"], 2)
    totals = reference.groupBy("user_id").agg(F.count("*").alias("n_reference"))
    return metrics.joined_reports(missed.select("user_id", "event_id", "text"), totals.select("user_id", "n_reference"))


LINES_SQL = f"""WITH {c.EV}, r AS (SELECT * FROM ev WHERE kind = 'click' AND event_id % 10 <> 0),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM ev v WHERE v.kind = 'view' AND v.user_id = r.user_id AND r.s < v.e AND r.e > v.s))
SELECT user_id, event_id, kind AS text, NULL::BIGINT AS n_reference FROM m WHERE n <= 2 UNION ALL SELECT user_id, NULL, NULL, count(*) FROM r GROUP BY user_id"""


def job_figures(spark, d):
    """Small rules over events: progress, stages, real-time factors, presets, model names, times, keys and names."""
    e = c.read(spark, d, "events")
    done, total = F.col("event_id") % 7, F.col("event_id") % 3 * 10
    preset = text.source_preset(F.when(F.col("event_id") % 2 == 0, "whisper x"), F.when(F.col("event_id") % 5 == 0, 0))
    model_name = F.when(F.col("event_id") % 2 == 0, "m:8b").otherwise("m")
    name = F.element_at(F.array(*[F.lit(x) for x in ("série 1", ".hidden", "a/b", "x_y-z", "dot. ")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        "event_id", text.percent_done(done, total).alias("percent"), text.stage_fraction(F.col("event_id") % 2, done * 10.0).alias("fraction"), text.real_time_factor(F.col("value"), done).alias("factor"),
        preset["gap_ms"].alias("gap_ms"), preset["cue_end_min_chars"].alias("least_chars"), text.model_tag(model_name).alias("model"), text.iso_time(F.col("ts").cast("timestamp")).alias("iso"),
        text.json_text(F.concat(F.lit('"é\\'), "event_type")).alias("quoted"), text.key_of(F.col("event_id"), F.col("event_type"), F.lit(None).cast("int")).alias("key"), text.valid_name(name).alias("good_name"),
        text.utf16_length(F.concat("event_type", F.lit("𠮷"))).alias("utf16"), text.round_half_up(F.col("event_id") / 2 - 100).alias("half_up"), text.clock(F.col("event_id") * 7).alias("clock"), text.timestamp(F.col("event_id") * 777).alias("stamp"),
    )


FIGURES_SQL = f"""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 100.0::DOUBLE * (event_id % 7) / (event_id % 3 * 10) END AS percent, greatest(0.0, (event_id % 2 + event_id % 7 * 10.0::DOUBLE / 100) / 2)::DOUBLE AS fraction,
CASE WHEN event_id % 7 > 0 THEN value / (event_id % 7) END AS factor, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 500 ELSE 2000 END AS gap_ms, CASE WHEN event_id % 2 = 0 THEN 8 END AS least_chars,
CASE WHEN event_id % 2 = 0 THEN 'm:8b' ELSE 'm:latest' END AS model, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, '"\\"é\\\\' || event_type || '"' AS quoted, sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '","col3":null}}') AS key,
event_id % 5 IN (0, 3) AS good_name, (length(event_type) + 2)::INT AS utf16, floor(event_id / 2.0 - 100 + 0.5)::BIGINT AS half_up, {c.CLOCK_SQL.replace("m ", "(event_id * 7000) ").replace("THEN printf", "THEN printf")} AS clock, {c._stamp_sql("event_id * 777")} AS stamp FROM events"""


def marked_sentences(spark, d):
    """Texts with full stops as Japanese ones, each followed by closers, cut after every mark and every closer."""
    rows = c.read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[!?。．！？\"'」』（）()）】〉》)]", ""), r"\.", "。」』").alias("s"))
    return rows.select("conv_id", "turn", F.posexplode(text.split_sentences(F.col("s"))).alias("pos", "piece")).filter("piece != ''")


SENTENCES_SQL = r"""WITH q AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '[!?。．！？"''」』（）()）】〉》)]', '', 'g'), '\.', '。」』', 'g') AS s FROM conversations),
x AS (SELECT conv_id, turn, regexp_extract_all(s, '[^。」』]*。|」|』|[^。」』]+$') AS ps FROM q)
SELECT conv_id, turn, (generate_subscripts(ps, 1) - 1)::INT AS pos, unnest(ps) AS piece FROM x"""


def float_samples(spark, d):
    e = c.read(spark, d, "events").select("event_id", F.array((F.col("event_id") % 65536 - 32768).cast("int"), F.lit(0), F.lit(16384)).alias("x"))
    return e.select("event_id", F.posexplode(transcripts.to_float(F.col("x"))).alias("pos", "y")).select("event_id", "pos", F.col("y").cast("double").alias("y"))


FLOAT_SQL = "SELECT event_id, pos::INT AS pos, ([event_id % 65536 - 32768, 0, 16384][pos + 1] / 32768.0::DOUBLE)::FLOAT::DOUBLE AS y FROM events, range(3) r(pos)"


def echo_match(spark, d):
    """Lines against copies: the line itself, with other marks, in half, and none; tested against brute force."""
    rows = lines_of(spark, d, F.lit("")).withColumn("copied", F.when(F.col("idx") % 4 == 0, F.col("ja")).when(F.col("idx") % 4 == 1, F.concat(F.lit("「"), "ja", F.lit("。」"))).when(F.col("idx") % 4 == 2, F.left("ja", (F.length("ja") / 2).cast("int"))))
    return rows.select("file_id", "idx", "ja", "copied", matching.echo_matches(F.col("ja"), F.col("copied")).alias("ok"))


# other marks are no difference, and half a line is all of one match: its ratio is twice its length over both
ECHO_MATCH_SQL = rf"""WITH {TALK}, e AS (SELECT file_id, idx, ja, CASE idx % 4 WHEN 0 THEN ja WHEN 1 THEN '「' || ja || '。」' WHEN 2 THEN left(ja, floor(length(ja) / 2)::INT) END AS copied FROM un),
n AS (SELECT *, length(regexp_replace(ja, '[\s、。，．！？!?「」『』…・〜ー~]', '', 'g')) AS a, length(regexp_replace(copied, '[\s、。，．！？!?「」『』…・〜ー~]', '', 'g')) AS b FROM e)
SELECT file_id, idx, ja, copied, CASE WHEN idx % 4 < 2 THEN true WHEN idx % 4 = 3 THEN false WHEN a = 0 OR b = 0 THEN a = b ELSE 2.0 * b / (a + b) >= 0.7 END AS ok FROM n"""


def zipped_lines(spark, d):
    units = kept_units(spark, d)
    return storage.with_positions(units.select("file_id", "idx", "ja"), units.select("file_id", "idx", F.upper("file_id").alias("en")), ["file_id", "idx"], "en")


def queries():
    names = """job_lines job_counts job_srt job_documents job_from_recogniser translate_retry translate_echo analysis analysis_counts resumed_translation judged_lines repaired_lines align_report prompt_frames
    gap_fill_segments gap_fill_stats recognised_windows media_outputs stream_blocks cues_from_words transcript_made pretty_json split_cues timed_sentences shifted_segments clipped_speech bilingual_srt transcripts_read glossary_store glossary_series job_progress wav_blocks result_cache resumed_windows
    progress_table queue_state folder_listing report_lines job_figures marked_sentences float_samples echo_match zipped_lines"""
    return {n: globals()[n] for n in names.split()}


def oracle_sql():
    return {
        "job_lines": f"WITH {TALK} SELECT file_id, idx, ja, start_ms, end_ms, en FROM un",
        "job_counts": COUNTS_SQL,
        "job_srt": JOB_SRT_SQL,
        "job_documents": JOB_DOCUMENTS_SQL,
        "job_from_recogniser": RECOGNISER_SQL,
        "translate_retry": TRANSLATE_SQL,
        "translate_echo": ECHO_SQL,
        "analysis": ANALYSIS_SQL,
        "resumed_translation": RESUMED_SQL,
        "analysis_counts": ANALYSIS_COUNTS_SQL,
        "transcript_made": TRANSCRIPT_SQL,
        "pretty_json": PRETTY_SQL,
        "echo_match": ECHO_MATCH_SQL,
        "judged_lines": JUDGED_SQL,
        "repaired_lines": REPAIRED_SQL,
        "align_report": ALIGN_SQL,
        "prompt_frames": PROMPT_SQL,
        "gap_fill_segments": FILL_SQL,
        "gap_fill_stats": FILL_STATS_SQL,
        "recognised_windows": RECOGNISED_SQL,
        "media_outputs": MEDIA_OUTPUTS_SQL,
        "stream_blocks": BLOCKS_SQL,
        "cues_from_words": CUES_SQL,
        "timed_sentences": TIMED_SQL,
        "shifted_segments": SHIFT_SQL,
        "clipped_speech": CLIP_SQL,
        "bilingual_srt": BILINGUAL_SQL,
        "transcripts_read": READ_SQL,
        "glossary_store": STORE_SQL,
        "glossary_series": SERIES_SQL,
        "job_progress": PROGRESS_SQL,
        "wav_blocks": WAV_SQL,
        "result_cache": CACHE_SQL,
        "resumed_windows": RESUME_SQL,
        "progress_table": "SELECT user_id % 30 AS line, max(event_id) AS answer FROM events GROUP BY 1",
        "queue_state": QUEUE_SQL,
        "folder_listing": FOLDER_SQL,
        "report_lines": LINES_SQL,
        "job_figures": FIGURES_SQL,
        "marked_sentences": SENTENCES_SQL,
        "float_samples": FLOAT_SQL,
        "zipped_lines": f"WITH {TALK} SELECT file_id, idx, ja, upper(file_id) AS en FROM un",
    }
