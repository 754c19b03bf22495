"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every
stage's result as Parquet to the shared scratch folder and reads it back for the next, so
a lost executor never repeats an earlier stage. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annspark.llm import bpe, mixing, quality_rules, sentence_spans, simhash
from annspark.llm.common import columns_of, fresh, read_table, written
from annspark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality_rules.quality_filter(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id."""
    return simhash.simhash_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated passages go, all but the first time; ``n_chars`` follows the
    text. A document that consists of repeated passages alone goes."""
    found, = fresh(docs, "span_dedup")
    cleaned = sentence_spans.sentence_span_dedup(docs, out_col=found)
    removed = F.col(found)["n_removed"] > 0
    emptied = removed & (F.trim("text") == "")
    return (cleaned.where(~F.coalesce(emptied, F.lit(False)))
            .withColumn("n_chars", F.when(removed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*columns_of(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their capped target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return bpe.encode_table(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixed),
    ("BPE encoding", tokens),
]

# SimHash and BPE are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
