"""The whole way from a transcript to subtitles: units, glossary, translation, display times, and what is written."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_time
from ..operators.timing import display_times, stretch
from ..sources.files import write_files
from ..sources.srt import render_cues, render_units
from ..sources.transcripts import recogniser_document, result_document, transcript_document
from .cues import to_transcript, to_units
from .model import Backend, analyse, check_and_repair, translate
from .recognition import Heard
from .storage import finish, kept, scratch

GAP_MS, WHISPER_GAP_MS, WHISPER_LEAST_CHARS = 2000, 500, 8


@dataclass
class Run:
    units: DataFrame  # with ``en``; the empty text where no answer held
    glossary: DataFrame
    failures: DataFrame  # one message per chunk with missing lines

    def counts(self) -> DataFrame:
        """(file_id, units, translated, missing, failed_chunks)."""
        done = self.units.groupBy("file_id").agg(F.count("*").alias("units"), F.count_if(F.col("en") != "").alias("translated"))
        failed = self.failures.groupBy("file_id").agg(F.count("*").alias("failed_chunks"))
        return done.withColumn("missing", F.col("units") - F.col("translated")).join(failed, "file_id", "left").na.fill(0, ["failed_chunks"])

    def messages(self) -> DataFrame:
        """(file_id, messages): failure messages in order of their chunks."""
        return self.failures.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "message"))), lambda x: x["message"]).alias("messages"))


@dataclass
class About:
    """What the result document says of how it was made."""

    backend: str | None = None
    model: str | None = None
    generated_at: str | None = None

    def of(self, cues: DataFrame, glossary: DataFrame, gap_ms: int) -> DataFrame:
        """(file_id, source, backend, model, gap_ms, generated_at, glossary)."""
        source = F.first("source", ignorenulls=True) if "source" in cues.columns else F.lit(None).cast("string")
        files = cues.groupBy("file_id").agg(source.alias("source")).join(glossary, "file_id", "left")
        at = F.lit(self.generated_at) if self.generated_at else iso_time(F.current_timestamp())
        return files.select("file_id", "source", F.lit(self.backend).alias("backend"), F.lit(self.model).alias("model"), F.lit(gap_ms).alias("gap_ms"), at.alias("generated_at"), "glossary")


def run(cues: DataFrame, translator: Backend, analyst: Backend, gap_ms: int = GAP_MS, cue_end_min_chars: int | None = None, limit: int = 0, known: DataFrame | None = None, initial: DataFrame | None = None, echo: bool = True, size: int = 20, in_flight: int = 1) -> Run:
    """Cues of all files -> units, what the analysis found, and translations. ``initial`` is kept, and only the rest is asked for."""
    units = kept(to_units(cues, gap_ms, cue_end_min_chars=cue_end_min_chars, limit=limit), "job-units")
    glossary = kept(analyse(units, analyst, known, in_flight=in_flight), "job-glossary")
    out, failures = translate(units, translator, glossary, echo, size, initial, in_flight)
    return Run(kept(out, "job-lines"), glossary, failures)


def outputs(cues: DataFrame, done: Run, bilingual: bool = False, about: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a job writes, by suffix: (file_id, srt) or (file_id, document)."""
    timed = display_times(done.units).filter("show_start_ms is not null")
    shown = {"start": "show_start_ms", "end": "show_end_ms", "least_ms": 0}
    found = {"ja.srt": render_cues(stretch(cues)), "en.srt": render_units(timed, **shown), "en.json": result_document(done.units, about=about)}
    if bilingual:
        found["ja-en.srt"] = render_units(timed, original="ja", **shown)
    return found


def subtitle_job(cues: DataFrame, translator: Backend, analyst: Backend, judging: Backend | None = None, bilingual: bool = False, from_recogniser: bool = False, about: About | None = None, **options) -> tuple[Run, dict[str, DataFrame]]:
    """A transcript's cues to all outputs; with a judge, lines that slipped are found and translated anew."""
    own = {"gap_ms": WHISPER_GAP_MS, "cue_end_min_chars": WHISPER_LEAST_CHARS} if from_recogniser else {}
    done = run(cues, translator, analyst, **(own | options))
    if judging is not None:
        units, _, _ = check_and_repair(done.units, translator, judging)
        done = Run(kept(units, "job-repaired"), done.glossary, done.failures)
    said = (about or About()).of(cues, done.glossary, (own | options).get("gap_ms", GAP_MS))
    return done, outputs(cues, done, bilingual, said)


def media_job(heard: Heard, ends: DataFrame, translator: Backend | None, analyst: Backend | None, source: str, about: About | None = None, **options) -> tuple[Run | None, dict[str, DataFrame]]:
    """What was heard to all outputs, those of the recogniser's side too; without a translator these alone.

    ``ends`` (file_id, end) tells how long the files are, ``source`` names the recogniser.
    """
    said, dropped = to_transcript(heard.segments)
    cues = kept(said.withColumn("source", F.lit(source)), "media-cues")
    at = F.lit(about.generated_at) if about and about.generated_at else iso_time(F.current_timestamp())
    files = ends.select("file_id", F.bround("end").cast("long").alias("duration_s"), F.lit(source).alias("source"), at.alias("captured_at"))
    found = {"whisper.json": recogniser_document(heard.segments, heard.windows, ends.select("file_id", F.col("end").alias("duration"))), "ja.json": transcript_document(cues, dropped, files)}
    if translator is None:
        return None, found | {"ja.srt": render_cues(stretch(cues))}
    done, more = subtitle_job(cues, translator, analyst, from_recogniser=source.startswith("whisper"), about=about, **options)
    return done, found | more


def output_files(found: dict[str, DataFrame], folders: int = 0) -> DataFrame:
    """(name, value): every output of every file, named by file and suffix; with ``folders`` also which of so many folders holds all of a file's."""
    below = [F.pmod(F.crc32(F.col("file_id").cast("binary")), F.lit(folders)).cast("int").alias("folder")] if folders else []
    rows = [df.select(*below, F.concat("file_id", F.lit(f".{suffix}")).alias("name"), F.col("document" if "document" in df.columns else "srt").alias("value")) for suffix, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


def write_outputs(found: dict[str, DataFrame], path: str, folders: int = 0) -> None:
    """One file for every output of every file, in one folder or dealt over so many ``folders`` in it; each is there whole or not at all."""
    write_files(output_files(found, folders), path, "folder" if folders else None)


def finished_job(cues: DataFrame, path: str, translator: Backend, analyst: Backend, **options) -> DataFrame:
    """Run :func:`subtitle_job`, write its outputs, delete its intermediate tables; (file_id, units, translated, missing, failed_chunks) comes back."""
    with scratch(cues.sparkSession):
        done, found = subtitle_job(cues, translator, analyst, **options)
        write_outputs(found, path)
        return finish(done.counts(), "job-counts")
