"""Glossaries that grow over the files of a series: a table (name, category, term, rendering, pos) and one of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import valid_name
from ..operators.folds import capped_merge
from ..schemas import GLOSSARY
from .tables import Table

CATEGORIES = ("names", "terms")
MOST_ENTRIES = 40


def load(names: DataFrame, entries: DataFrame, totals: DataFrame) -> DataFrame:
    """(name, files, names, terms) of the wanted ``names``; one that was never stored is empty, a bad name is an error."""
    maps = entries.groupBy("name").pivot("category", list(CATEGORIES)).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "rendering"))), lambda x: F.struct(x["term"], x["rendering"]))))
    checked = F.when(valid_name(F.col("name")), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not a glossary name: "), F.col("name"))).cast("string"))
    empty = F.create_map().cast("map<string,string>")
    rows = names.select(checked.alias("name")).join(totals.select("name", "files"), "name", "left").join(maps, "name", "left")
    return rows.select("name", F.coalesce("files", F.lit(0)).alias("files"), *[F.coalesce(c, empty).alias(c) for c in CATEGORIES])


def seeds(loaded: DataFrame) -> DataFrame:
    """(name, known): what a new analysis is told, as JSON; nothing for glossaries without entries."""
    known = F.to_json(F.struct(*CATEGORIES))
    return loaded.filter(F.size("names") + F.size("terms") > 0).select("name", known.alias("known"))


def entries_of(found: DataFrame) -> DataFrame:
    """(name, glossary JSON) of one file each -> (name, category, term, rendering, pos); what is not text is left out."""
    parts = [found.select("name", F.lit(c).alias("category"), F.posexplode(F.from_json(F.get_json_object("glossary", f"$.{c}"), "map<string,string>")).alias("pos", "term", "rendering")) for c in CATEGORIES]
    return parts[0].unionByName(parts[1])


def remember(entries: DataFrame, totals: DataFrame, found: DataFrame, most: int = MOST_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(entries, totals) after one more file for each name in ``found`` (name, glossary): what is stored wins, ``totals`` tells how many entries are new."""
    merged = capped_merge(entries, entries_of(found), ["name", "category"], most)
    before = entries.groupBy("name").agg(F.count("*").alias("before"))
    after = merged.groupBy("name").agg(F.count("*").alias("after"))
    seen = found.groupBy("name").agg(F.count("*").alias("more"))
    rows = totals.select("name", "files").join(seen, "name", "full").join(before, "name", "left").join(after, "name", "left").na.fill(0)
    return merged, rows.select("name", (F.col("files") + F.col("more")).alias("files"), (F.col("after") - F.col("before")).alias("new"))


# --- a store that several jobs change -----------------------------------------------------------------

TOTAL = "#"  # the category of the row that counts a glossary's files


def store(spark: SparkSession, path: str) -> Table:
    """Entries of all glossaries, and per glossary a row of category ``TOTAL`` whose ``pos`` counts its files."""
    return Table(spark, path, GLOSSARY, ["name", "category", "term"])


def in_store(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, totals) of a store's rows."""
    return held.filter(F.col("category") != TOTAL), held.filter(F.col("category") == TOTAL).select("name", F.col("pos").cast("long").alias("files"))


def remember_in(table: Table, found: DataFrame, most: int = MOST_ENTRIES) -> int:
    """:func:`remember` in a store. Where another job changed it meanwhile, the merge is worked out anew, so neither loses an entry."""

    def rows(held: DataFrame) -> DataFrame:
        entries, totals = in_store(held)
        merged, after = remember(entries, totals, found, most)
        new = merged.join(entries, table.keys, "left_anti")
        counted = after.join(found, "name", "left_semi").select("name", F.lit(TOTAL).alias("category"), F.lit("").alias("term"), F.lit(None).cast("string").alias("rendering"), F.col("files").cast("int").alias("pos"))
        return new.unionByName(counted)

    return table.change(rows)


def known_for(files: DataFrame, table: Table) -> DataFrame:
    """``files`` (file_id, name) -> (file_id, known): what the analysis of each file is told from its glossary."""
    entries, totals = in_store(table.read())
    told = seeds(load(files.select("name").distinct(), entries, totals))
    return files.join(told, "name").select("file_id", "known")
