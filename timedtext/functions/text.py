"""Scalar functions on text, times and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation and character classes that decide results.
SENTENCE_MARKS = "。．！？!?"
CLOSERS = "\"'」』）)】〉》"
PHANTOM_STRIP = r"(?U)[\s、。，．！？!?・「」『』…ー〜~]"
CLAUSE_END = r"[ぁ-ゟ、。，．！？!?…」』)]"
NO_CLAUSE_START = r"[ぁぃぅぇぉゃゅょっゎァィゥェォャュョッヮーゝゞ々]"
# Phrases that recognisers make from silence or music, matched against whole segments.
PHANTOMS = (
    r"ご視聴(?:ありがとうございま(?:した|す))?",
    r"(?:最後まで)?ご覧いただきありがとうございま(?:した|す)",
    r"チャンネル登録(?:よろしくお願いします|お願いします)?",
    r"(?:高評価|グッドボタン)(?:とチャンネル登録)?(?:よろしくお願いします|お願いします)?",
    r"字幕(?:作成|制作)?(?:者)?.{0,12}",
    r"(?:作詞|作曲|編曲)(?:・?(?:作詞|作曲|編曲))*.{0,20}",
    r"(?:次回|また次)の?(?:動画|配信)(?:で|も)?(?:お会いしましょう|会いましょう)?",
)
STAMP = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"


def utf16_length(s: Column) -> Column:
    """UTF-16 code units; characters beyond the basic plane count two."""
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("int")


def round_half_up(x: Column) -> Column:
    """Halves go towards +infinity, exactly."""
    return (F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)).cast("bigint")


def round_decimals(x: Column, digits: int = 3) -> Column:
    """Round the binary value of ``x`` to decimals, exact halves to even, as a decimal printout of it would be.

    ``x`` times a power of ten has too many bits for a double, so the product is kept as two exact parts.
    """
    scale, fine = float(10**digits), float(1 << 26)
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole
    high = F.floor(part * fine) / fine * scale
    low = (part - F.floor(part * fine) / fine) * scale
    n = F.floor(high)
    over = high - n - 0.5 + F.lit(0.0)
    up = (over > -low) | ((over == -low) & (n % 2 == 1))
    out = (whole * scale + n + F.when(up, 1).otherwise(0)) / scale
    return F.when(x < 0, -out).otherwise(out)


def to_ms(seconds: Column) -> Column:
    return F.bround(seconds * 1000).cast("bigint")


def strip(s: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def squeeze(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def timestamp(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; negative times are 0 and hours are not bounded."""
    t = F.greatest(F.bround(ms).cast("bigint"), F.lit(0).cast("bigint"))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def stamp_ms(line: Column, first: int) -> Column:
    """Milliseconds of the stamp whose hours are capture group ``first`` (1 or 5)."""
    h, m, s, ms = (F.regexp_extract(line, STAMP, first + k).cast("bigint") for k in range(4))
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def clock(seconds: Column) -> Column:
    """``H:MM:SS``, or ``M:SS`` under an hour."""
    t = F.floor(seconds).cast("bigint")
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def ends_sentence(s: Column) -> Column:
    return s.rlike(rf"(?U)[{SENTENCE_MARKS}]+[{CLOSERS}]*\s*\z")


def is_tag_only(s: Column) -> Column:
    return strip(s).rlike(r"^[\[［][^\]］]*[\]］]$")


def is_clause_break(before: Column, after: Column) -> Column:
    """Could a clause end between these two word pieces?"""
    b, a = strip(before), strip(after)
    return (b != "") & (a != "") & F.right(b, F.lit(1)).rlike(CLAUSE_END) & ~F.left(a, F.lit(1)).rlike(NO_CLAUSE_START)


def is_phantom(text: Column, no_speech: Column, least: float = 0.5) -> Column:
    bare = F.regexp_replace(text, PHANTOM_STRIP, "")
    return (bare != "") & bare.rlike("^(?:" + "|".join(PHANTOMS) + ")$") & (F.coalesce(no_speech, F.lit(0.0)) >= least)


def is_gap_fragment(text: Column, gap_fill: Column) -> Column:
    return F.coalesce(gap_fill, F.lit(False)) & (F.length(F.regexp_replace(text, PHANTOM_STRIP, "")) <= 1)


def split_sentences(s: Column) -> Column:
    """Cut after every sentence mark, and after every closer that follows a mark directly or through other closers."""
    return F.split(F.regexp_replace(s, rf"([{SENTENCE_MARKS}]|(?!\A)\G[{CLOSERS}])", f"$1{CUT}"), CUT)


def split_marks(s: Column) -> Column:
    """Cut after every sentence mark."""
    return F.split(F.regexp_replace(s, f"([{SENTENCE_MARKS}])", f"$1{CUT}"), CUT)


def wrap(text: Column, most_chars: int = 42, most_lines: int = 3) -> Column:
    """Greedy word wrap by UTF-16 length; what is left over stays on the last line."""
    words = F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", " "), " "), lambda w: w != "")

    def step(lines: Column, word: Column) -> Column:
        last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
        fits = (F.size(lines) > 0) & (utf16_length(last) + 1 + utf16_length(word) <= most_chars)
        joined = F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, word)))
        return F.when(fits, joined).otherwise(F.concat(lines, F.array(word)))

    lines = F.aggregate(words, F.array().cast("array<string>"), step)
    cut = F.concat(F.slice(lines, 1, most_lines - 1), F.array(F.array_join(F.slice(lines, F.lit(most_lines), F.greatest(F.size(lines) - (most_lines - 1), F.lit(0))), " ")))
    return F.array_join(F.when(F.size(lines) > most_lines, cut).otherwise(lines), "\n")


def recover_json(reply: Column) -> Column:
    """A VARIANT from an untrusted reply: as it is, without fences, or from the first ``{`` to the last ``}``; else null."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)\s*```\s*$", "")
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(bare), F.try_parse_json(inner))


def fill(template: str, values: dict[str, Column]) -> Column:
    """``${name}`` places filled in one pass, so values are never expanded again; unknown names raise KeyError."""
    parts: list[Column] = []
    rest = template
    while "${" in rest:
        head, _, rest = rest.partition("${")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def key_of(*columns: Column) -> Column:
    """SHA-256 over the values as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


# File suffixes by kind, in alphabetical order.
VIDEO = ("avi", "flv", "m4v", "mkv", "mov", "mp4", "ts", "webm")
AUDIO = ("aac", "flac", "m4a", "mp3", "ogg", "opus", "wav")
# No text holds this code point: Unicode keeps it from being a character.
CUT = "\ufdd0"


def media_kind(path: Column) -> Column:
    """transcript, audio, video, or null for other files."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(path.endswith(".ja.json"), "transcript").when(suffix.isin(*VIDEO), "video").when(suffix.isin(*AUDIO), "audio")


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.endswith(".ja.json"), F.regexp_replace(name, r"\.ja\.json$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def model_tag(model: Column) -> Column:
    return F.when(model.contains(":"), model).otherwise(F.concat(model, F.lit(":latest")))


def source_preset(source: Column, gap_ms: Column | None = None) -> Column:
    """Options by origin: recogniser output has tighter gaps and may end units at cue ends; a given gap wins."""
    own = F.coalesce(source, F.lit("")).startswith("whisper")
    gap = F.when(own, 500).otherwise(2000)
    return F.struct((gap if gap_ms is None else F.coalesce(gap_ms, gap)).alias("gap_ms"), F.when(own, 8).alias("cue_end_min_chars"))


def iso_time(at: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a time stamp, in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_text(s: Column) -> Column:
    """One string as JSON writes it, quotes and all; characters beyond ASCII stay."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("s")), {"ignoreNullFields": "false"}), r"(?s)^\{\"s\":(.*)\}$", 1)


def json_pretty(value: Column) -> Column:
    """A struct, map or array as indented JSON."""
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})


def valid_name(name: Column) -> Column:
    """May a stored glossary have this name? Letters, digits, - _ . and spaces, with no dot or space at either end."""
    return name.rlike(r"(?U)^[\w\-. ]+$") & ~name.rlike(r"^[. ]|[. ]$")


def stage_fraction(stage: Column, percent: Column) -> Column:
    """How far a job of two stages is: 0 to 1."""
    return F.greatest(F.lit(0.0), (stage + F.coalesce(percent, F.lit(0.0)) / 100) / 2)


def percent_done(done: Column, total: Column) -> Column:
    """Null where nothing is known of the total."""
    return F.when(total > 0, 100.0 * done / total)


def real_time_factor(seconds: Column, elapsed: Column) -> Column:
    """Seconds of sound per second of work; null where no time went by."""
    return F.when(elapsed > 0, seconds / elapsed)
