"""A corpus pipeline: each stage calls one operator of ``logtide.llm`` on what the last one kept.

All stages take empty tables, null texts and doc_ids, repeated rows and extra columns of any name;
what becomes of them the stages say.  All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import cotraining, lines, packing, passages, simhash
from logtide.llm.common import free_names, own_columns, quoted, scratch_path
from logtide.llm.queries import _path


def _texts_of(operator, docs: DataFrame, *counts: str) -> DataFrame:
    """The columns of ``docs`` with the texts of ``operator(docs)`` and, where there is one, ``n_chars``
    counted anew.  Columns named like the operator's ``counts`` keep their values under other names meanwhile."""
    clash = [c for c in docs.columns if c not in own_columns(docs, *counts)]
    aside = dict(zip(clash, free_names(docs, *(f"_{c}" for c in clash)), strict=True))
    done = operator(docs.withColumnsRenamed(aside))
    size = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return done.select(*(size.alias(c) if c.lower() == "n_chars" else quoted(aside.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; with too few labels none does."""
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; ``n_chars`` follows the text; null texts become empty."""
    return _texts_of(lines.dedup_lines, docs, "n_lines", "n_dropped")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word passages that an earlier document has go; ``n_chars`` follows the text."""
    return _texts_of(passages.remove_passages, docs, "n_words", "n_removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in full sequences; null texts give the end id alone."""
    return packing.pack(docs, _path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]
ORACLE_SQL = None  # the classifier is trained and the packer is a greedy assignment: tested by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
