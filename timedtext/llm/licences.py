r"""Licence scan by a positional rare-token index (DataFrame functions only).

Templates are licence notices and phrases: settings, at most ``MOST_TEMPLATES`` of ``MOST_WORDS`` words. The index
posts (word, template, place) for each template's words that the fewest documents hold: its highest-IDF words,
as many as make it certain that a file with enough of the template holds one of them (with ``need`` of n
words in place, any n - need + 1 of them). A file looks up those of its words that the index knows. Every posting it meets
puts the template at a place of the file, by relative position, and there the template's other words are
compared place by place. A match has at least ``need`` words in place and the template's key phrase whole. Base phrases are
templates that must be there whole.

Document frequencies are counted over all documents for the templates' words alone, so the index is as large
as the templates, however many files there are. Files are worked on row by row and nothing of theirs is shuffled
but the counts; what a file looks at grows with its rare words.

Defined cases: null text is empty; files without words have no match and score 0; repeated rows are files of their
own; words are those of the text with A-Z lower-cased, other letters as they are; equal document frequencies go by word and
place; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN, OTHER = "\u212a", "\u00e5"
MOST_TEMPLATES, MOST_WORDS, SHARE = 1000, 1000, 0.8


@dataclass(frozen=True)
class Template:
    """``text`` in lower-case words; ``key`` is a part of it that must stand whole."""

    label: str
    text: str
    key: str
    share: float = SHARE

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def need(self) -> int:
        return -int(-len(self.words) * round(self.share * 100) // 100)

    @property
    def key_at(self) -> tuple[int, int]:
        """First and last place of the key in the text."""
        key = self.key.split()
        first = next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)
        return first, first + len(key) - 1


def phrase(label: str, text: str) -> Template:
    return Template(label, text, text, 1.0)


BASE = (phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved"))
# Wordings of well-known notices.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", "has waived all copyright"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased. One sign beyond ASCII has an ASCII letter as its lower case; it is kept from that."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER))), F.lit(WORD), 0)


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many files hold each word of the templates. The driver gets one row per such word."""
    held = F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary)))
    counts = files.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in counts.collect()}


def rare_postings(templates: tuple[Template, ...], df: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, place): of every template its rarest words, so many that no match can be without all of them."""
    out = []
    for t, template in enumerate(templates):
        rarest = sorted((df[w], w, place) for place, w in enumerate(template.words))
        out += [(w, t, place) for _, w, place in rarest[: len(template.words) - template.need + 1]]
    return out


def matches(words: Column, templates: tuple[Template, ...], postings: list[tuple[str, int, int]]) -> Column:
    """Array of (label, base, start, share), one for every place where a template stands."""
    index = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("t"), F.lit(p).alias("place")) for w, t, p in postings])
    rows = [F.struct(F.lit(x.label).alias("label"), F.lit(x.share == 1.0).alias("base"), F.array(*map(F.lit, x.words)).alias("words"), F.lit(x.need).alias("need"), F.lit(x.key_at[0]).alias("lo"), F.lit(x.key_at[1]).alias("hi")) for x in templates]
    listed = F.array(*rows)
    known = sorted({w for w, _, _ in postings})
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*known), F.struct(w.alias("word"), i.cast("long").alias("at")))))
    # (place, template) as one number: distinct numbers are found by hashing, distinct structs by comparing all pairs
    put = lambda h: F.transform(F.filter(index, lambda p: p["word"] == h["word"]), lambda p: (h["at"] - p["place"]) * MOST_TEMPLATES + p["t"])
    found = F.array_distinct(F.flatten(F.transform(hits, put)))
    placed = F.transform(found, lambda x: F.struct(F.element_at(listed, (F.pmod(x, F.lit(MOST_TEMPLATES)) + 1).cast("int")).alias("t"), F.floor(x / MOST_TEMPLATES).cast("int").alias("start")))
    at = lambda c, j: F.get(words, c["start"] + j)
    counted = F.transform(placed, lambda c: F.struct(c["t"].alias("t"), c["start"].alias("start"), F.size(F.filter(c["t"]["words"], lambda w, j: at(c, j).eqNullSafe(w))).alias("n")))
    whole_key = lambda c: F.forall(F.sequence(c["t"]["lo"], c["t"]["hi"]), lambda j: at(c, j).eqNullSafe(F.get(c["t"]["words"], j)))
    good = F.filter(counted, lambda c: (c["n"] >= c["t"]["need"]) & whole_key(c))
    return F.transform(good, lambda c: F.struct(c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), c["start"].cast("long").alias("start"), (c["n"] / F.size(c["t"]["words"])).alias("share")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """(doc_id, n_words, found): what stands where in every file."""
    if len(templates) > MOST_TEMPLATES or any(len(t.words) > MOST_WORDS for t in templates):
        raise ValueError(f"more than {MOST_TEMPLATES} templates, or one of more than {MOST_WORDS} words")
    files = docs.select("doc_id", words_of(text_of()).alias("words"))
    df = document_frequencies(files, sorted({w for t in templates for w in t.words}))
    return files.select("doc_id", F.size("words").cast("long").alias("n_words"), matches(F.col("words"), templates, rare_postings(templates, df)).alias("found"))


def op12_rare_token_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("found", lambda m: m["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def _template_rows(templates: tuple[Template, ...]) -> str:
    row = "({t}, '{label}', {base}, {need}, {size}, {keys}, {place}, '{word}', {key})"
    out = []
    for t, x in enumerate(templates):
        lo, hi = x.key_at
        out += [row.format(t=t, label=x.label, base=x.share == 1.0, need=x.need, size=len(x.words), keys=hi - lo + 1, place=p, word=w, key=int(lo <= p <= hi)) for p, w in enumerate(x.words)]
    return ", ".join(out)


# every template at every place where any of its words would put it
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
t(t, label, base, need, size, keys, place, word, key) AS (VALUES {_template_rows(BASE + NOTICES)}),
m AS (
  SELECT doc_id, t, pos - place AS start, any_value(label) AS label, any_value(base) AS base, count(*) / any_value(size) AS share
  FROM w JOIN t USING (word) GROUP BY doc_id, t, pos - place HAVING count(*) >= any_value(need) AND sum(key) = any_value(keys)
), g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM m GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id)
"""
