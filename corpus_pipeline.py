"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before kept; it is written as
Parquet and read again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroscope.llm import lines, mixing, packing, simhash, tokens, toxicity
from aeroscope.llm.common import quoted, saved, table, unused
from aeroscope.llm.queries import MIX_BLOCK, MIX_SHARES

#: Score from which a document counts as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold, by a model of the labels (held-out ones not used); all columns as they are."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, F.col("text")) < TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut out of the texts; n_chars follows. Every row stays."""
    found = lines.dedup_lines(docs)
    n_chars = F.when(F.col(unused(docs, "_spans")).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.withColumn("n_chars", n_chars).select(*[quoted(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of its slot: the schedule runs on over the sources that still have blocks."""
    return mixing.mix(docs, MIX_SHARES, MIX_BLOCK).orderBy(F.col("slot").asc_nulls_last(), "row.doc_id").select("row.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids, each with its place in a sequence; sequences follow the order that `mix_sources` wrote, range by range."""
    return packing.pack_ordered(docs, tokens.vocabulary_path(), packing.SLOTS * MIX_BLOCK)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
