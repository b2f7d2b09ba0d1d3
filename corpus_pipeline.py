"""A training corpus from ``documents``: five stages, each a distributed operator of timedtext.llm.

1. toxicity: a classifier is fitted on a bounded sample of ``labels``; documents that it rejects go.
2. near_dedup: one document of each group of near copies stays.
3. substring_dedup: passages that occur more than once stay at their first place only.
4. mixing: sources are sampled to their target weights; a document may be taken up to three times.
5. packing: token pieces are laid into sequences.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``. The job owns its
session: stages hand on frames that run later, so the bound on batches to Python is set for the session.

Defined cases, by stage:

- null and empty texts: scored as the intercept says; no copies of one another unless they share a doc_id, so kept;
  without passages; of size 0, so never taken by the mix.
- very long texts: whole in every stage; the packer cuts them into pieces.
- ties: the smaller doc_id, then the earlier word, stays; equal ranks of the mix go by doc_id and text.
- repeated rows: scored alike; one of them stays; the mix may take what stays up to three times, and the
  packer packs each.
- empty tables: every stage returns an empty table; without labels nothing is rejected.
- extra columns of any name: carried through to the packer, which returns pieces.
- null doc_ids: rows like others to stages 1, 2, 4 and 5; stage 3 leaves their texts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import mixing, neardup, packing, paragraphs, toxicity
from timedtext.llm.common import bound_session, drop_tables, finish, free_name, scratch, table

#: The stages cannot be expressed in SQL; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None
REJECT_AT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from ``labels`` on the documents at hand; keeps what scores under ``REJECT_AT``."""
    bound_session(spark)
    with scratch(spark):
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "toxicity_score")
    return toxicity.score(docs, model, docs.columns, name).filter(F.col(name) < REJECT_AT).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_session(spark)
    return neardup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_session(spark)
    return paragraphs.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_session(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark):
            docs = finish(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(*held)
        held = [docs]
    return docs
