"""The model seam: prompts, calls, checked answers, bounded retries, and repair of shifted lines.

A backend is any picklable ``prompt -> reply``; recognition and translation models are injected. Calls run
in partitions, one per request row; everything around them is DataFrame work. Rounds ask only for what
is outstanding, and every round's answers are written to the shared folder, so none is asked for twice.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import echo_matches
from ..functions.text import fill, recover_json, strip
from ..operators.chunks import chunk
from ..operators.folds import budget_sample
from ..operators.islands import flag_margin, runs
from .storage import kept, with_positions

Backend = Callable[[str], str]
TRIES = 3
JUDGE_BATCH = 15
AT_ONCE = 256

ANALYSIS = """Read this transcript and answer with JSON: setting, speakers, register (texts), names, terms, asr_corrections (objects).
${known}Text:
${text}"""
TRANSLATION = """Translate the numbered lines to English. Answer with JSON.
${glossary}${before}${after}Lines:
${lines}
Example: ${example}"""
JUDGING = """For each numbered English line say which source line it translates: A, B, C or NONE. Answer with JSON.
${items}"""


def call(requests: DataFrame, backend: Backend, key_columns: list[str], in_flight: int = 1) -> DataFrame:
    """(keys, prompt) -> (keys, reply); a failed call gives a null reply and its error.

    Each task has up to ``in_flight`` requests under way at once, and holds the replies of ``AT_ONCE`` requests; replies stay with their requests.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.select(*key_columns).schema.fields)

    def ask(prompt: str) -> tuple[str | None, str | None]:
        try:
            return backend(prompt), None
        except Exception as e:  # one bad request must not end the others
            return None, str(e)[:200]

    def run(batches):
        import pyarrow as pa

        with ThreadPoolExecutor(max(1, in_flight)) as pool:
            for whole in batches:
                for at in range(0, whole.num_rows, AT_ONCE):
                    some = whole.slice(at, AT_ONCE)
                    said = zip(*pool.map(ask, some.column("prompt").to_pylist()), strict=True)
                    replies = [pa.array(x, whole.schema.field("prompt").type) for x in said]
                    yield pa.RecordBatch.from_arrays([*(some.column(k) for k in key_columns), *replies], [*key_columns, "reply", "error"])

    return requests.select(*key_columns, "prompt").mapInArrow(run, fields + ", reply string, error string")


def analyse(units: DataFrame, backend: Backend, known: DataFrame | None = None, budget: int = 6000, in_flight: int = 1) -> DataFrame:
    """(file_id, glossary JSON or null): up to three tries per file, the first useful reply counts."""
    text = budget_sample(units, ["file_id"], "idx", "ja", budget).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ja"))), lambda x: x["ja"]), "\n").alias("text"))
    text = text.join(known, "file_id", "left") if known is not None else text.withColumn("known", F.lit(None).cast("string"))
    asked = text.select("file_id", fill(ANALYSIS, {"known": F.coalesce(F.concat(F.lit("Known: "), "known", F.lit("\n")), F.lit("")), "text": F.col("text")}).alias("prompt"))
    count = lambda k: F.coalesce(F.size(F.from_json(F.get_json_object("glossary", f"$.{k}"), "map<string,string>")), F.lit(0))
    useful = (strip(F.coalesce(F.get_json_object("glossary", "$.setting"), F.lit(""))) != "") | (count("names") + count("terms") + count("asr_corrections") > 0)
    done, left = None, asked
    for _ in range(TRIES):
        got = call(left, backend, ["file_id"], in_flight).select("file_id", F.to_json(recover_json(F.col("reply"))).alias("glossary")).filter(useful)
        got = kept(got, "model-analysis")
        left = left.join(got, "file_id", "left_anti")
        done = got if done is None else done.unionByName(got)
    return units.select("file_id").distinct().join(done, "file_id", "left")


def glossary_counts(found: DataFrame) -> DataFrame:
    """(file_id, names, terms, asr_corrections): how many of each an analysis found; none where it is null or not an object."""
    n = lambda k: F.coalesce(F.size(F.from_json(F.get_json_object("glossary", f"$.{k}"), "map<string,string>")), F.lit(0)).alias(k)
    return found.select("file_id", n("names"), n("terms"), n("asr_corrections"))


def frames_of(units: DataFrame, size: int) -> DataFrame:
    """(file_id, chunk, before, after): what is shown around each chunk. It is source text, so chunks do not depend on one another."""
    return chunk(units, size).select("file_id", "chunk", "before", "after")


def requests_for(outstanding: DataFrame, frames: DataFrame, glossary: DataFrame, echo: bool, size: int) -> DataFrame:
    """One prompt per chunk with outstanding lines (file_id, idx, ja)."""
    line = F.struct("idx", F.concat((F.col("idx") + 1).cast("string"), F.lit(": "), F.col("ja")).alias("line"), "ja")
    wanted = outstanding.withColumn("chunk", F.floor(F.col("idx") / size).cast("int")).groupBy("file_id", "chunk").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    rows = wanted.join(frames, ["file_id", "chunk"]).join(glossary, "file_id", "left")
    block = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(c, "\n"), F.lit("\n"))).otherwise("")
    shape = '{"ja": "...", "en": "..."}' if echo else '"..."'
    example = F.concat(F.lit("{"), F.array_join(F.transform(F.slice("rows", 1, 2), lambda r: F.concat(F.lit('"'), (r["idx"] + 1).cast("string"), F.lit(f'": {shape}'))), ", "), F.lit("}"))
    values = {"glossary": F.coalesce(F.concat(F.lit("Glossary: "), "glossary", F.lit("\n")), F.lit("")), "before": block("Before", F.col("before")), "after": block("After", F.col("after")), "lines": F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), "example": example}
    return rows.select("file_id", "chunk", fill(TRANSLATION, values).alias("prompt"))


def accept(asked: DataFrame, replies: DataFrame, echo: bool, last_try: bool, size: int) -> DataFrame:
    """(file_id, idx, en) of the answers that hold: strings only, and in echo mode a copy that matches the source line."""
    rows = asked.withColumn("chunk", F.floor(F.col("idx") / size).cast("int")).join(replies.withColumn("v", F.to_json(recover_json(F.col("reply")))), ["file_id", "chunk"])
    rows = rows.withColumn("raw", F.from_json("v", "map<string,string>")[(F.col("idx") + 1).cast("string")]).drop("v")
    copied, en = F.get_json_object("raw", "$.ja"), F.get_json_object("raw", "$.en")
    is_object = F.coalesce(F.col("raw").startswith("{"), F.lit(False))
    if echo:
        bare = F.when(F.lit(last_try) & ~is_object, F.col("raw"))
        text = F.when(is_object, F.when(echo_matches(F.col("ja"), copied), en)).otherwise(bare)
    else:
        text = F.when(~is_object, F.col("raw"))
    return rows.select("file_id", "idx", strip(text).alias("en")).filter("en is not null and en != ''")


def no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file_id string, idx int, en string")


def answers(wanted: DataFrame, frames: DataFrame, backend: Backend, glossary: DataFrame, echo: bool, size: int, in_flight: int = 1) -> DataFrame:
    """(file_id, idx, en) of the lines in ``wanted`` (file_id, idx, ja) that got an answer: each chunk is asked once and twice more for lines still missing."""
    done, left = no_lines(wanted.sparkSession), kept(wanted.select("file_id", "idx", "ja"), "model-left")
    for k in range(TRIES):
        if left.isEmpty():
            break
        replies = call(requests_for(left, frames, glossary, echo, size), backend, ["file_id", "chunk"], in_flight)
        got = kept(accept(left, replies, echo, k == TRIES - 1, size), "model-lines")
        done = done.unionByName(got)
        left = kept(left.join(got, ["file_id", "idx"], "left_anti"), "model-left")
    return done


def with_lines(units: DataFrame, lines: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(units with en, failures): a message for every chunk with missing lines."""
    out = units.join(lines, ["file_id", "idx"], "left").withColumn("en", F.coalesce("en", F.lit("")))
    missing = out.filter("en = ''").groupBy("file_id", F.floor(F.col("idx") / size).cast("int").alias("chunk"))
    failures = missing.agg(F.array_sort(F.collect_list(F.col("idx") + 1)).alias("lines")).select("file_id", "chunk", F.concat(F.lit("chunk "), F.col("chunk") + 1, F.lit(": missing lines "), F.array_join(F.transform("lines", lambda n: n.cast("string")), ", ")).alias("message"))
    return out, failures


def translate(units: DataFrame, backend: Backend, glossary: DataFrame | None = None, echo: bool = False, size: int = 20, initial: DataFrame | None = None, in_flight: int = 1) -> tuple[DataFrame, DataFrame]:
    """(units with en, failures). ``initial`` (file_id, idx, en) is kept, and only what it lacks is asked."""
    spark = units.sparkSession
    glossary = glossary if glossary is not None else spark.createDataFrame([], "file_id string, glossary string")
    done = (initial if initial is not None else no_lines(spark)).select("file_id", "idx", "en").filter("en is not null and trim(en) != ''")
    got = answers(units.join(done, ["file_id", "idx"], "left_anti"), frames_of(units, size), backend, glossary, echo, size, in_flight)
    return with_lines(units, done.unionByName(got), size)


def judge(units: DataFrame, backend: Backend, only: DataFrame | None = None) -> DataFrame:
    """(file_id, idx, verdict): which source line each translation belongs to; ``?`` where no answer came."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file_id").orderBy("idx")
    none = F.lit("(nothing)")
    rows = units.select("file_id", "idx", "ja", "en", F.lag("ja", 1).over(w).alias("prev"), F.lead("ja", 1).over(w).alias("next")).filter("en is not null and en != ''")
    if only is not None:
        rows = rows.join(only, ["file_id", "idx"], "left_semi")
    rows = rows.withColumn("n", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("n") / JUDGE_BATCH).cast("int")).withColumn("k", (F.col("n") % JUDGE_BATCH + 1).cast("int"))
    item = F.concat(F.col("k").cast("string"), F.lit('. English: "'), "en", F.lit('"\n   A: '), F.coalesce("prev", none), F.lit("\n   B: "), "ja", F.lit("\n   C: "), F.coalesce("next", none))
    asked = rows.groupBy("file_id", "batch").agg(F.array_sort(F.collect_list(F.struct("k", item.alias("item")))).alias("items"))
    asked = asked.select("file_id", "batch", fill(JUDGING, {"items": F.array_join(F.transform("items", lambda x: x["item"]), "\n\n")}).alias("prompt"))
    replies = call(asked, backend, ["file_id", "batch"]).select("file_id", "batch", F.from_json(F.to_json(recover_json(F.col("reply"))), "map<string,string>").alias("m"))
    letter = F.upper(strip(F.coalesce(F.col("m")[F.col("k").cast("string")], F.lit(""))))
    verdict = F.when(letter == "A", "prev").when(letter == "B", "same").when(letter == "C", "next").when(letter == "NONE", "none").otherwise("?")
    found = rows.join(replies, ["file_id", "batch"], "left").select("file_id", "idx", verdict.alias("verdict"))
    return units.select("file_id", "idx").join(found, ["file_id", "idx"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("?")))


def check_and_repair(units: DataFrame, translator: Backend, judging: Backend, size: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, runs found, runs left): shifted runs and two lines around them are translated anew, with echo."""
    found = runs(kept(judge(units, judging), "model-verdicts"), ["file_id"], "idx", "verdict", ["prev", "next"])
    n = units.groupBy("file_id").agg(F.count("*").cast("int").alias("n"))
    flagged = flag_margin(found.join(n, "file_id"), ["file_id"], "n", 2)
    sound = units.select("file_id", "idx", "en").join(flagged, ["file_id", "idx"], "left_anti")
    new, _ = translate(units.drop("en"), translator, echo=True, size=size, initial=sound)
    old = units.select("file_id", "idx", F.col("en").alias("old"))
    out = with_positions(new, old, ["file_id", "idx"], "old").withColumn("en", F.coalesce(F.when(F.col("en") != "", F.col("en")), "old")).drop("old")
    near = flag_margin(flagged.select("file_id", F.col("idx").alias("first"), F.col("idx").alias("last")).join(n, "file_id"), ["file_id"], "n", 1)
    left = runs(judge(out, judging, near), ["file_id"], "idx", "verdict", ["prev", "next"])
    return out, found, left
