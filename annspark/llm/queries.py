"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from annspark.llm import (
    bpe,
    chat_format,
    hard_negatives,
    lattice,
    license_scan,
    mixing,
    quality_classifier,
    quality_rules,
    sentence_spans,
    simhash,
    token_rollups,
    url_filter,
    whitening,
)
from annspark.llm.common import read_table, written
from annspark.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

BPE_FILE = "byte_bpe_50k.json"
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def tokenizer_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_table(docs, tokenizer_path(), with_ids=False)


def op2_mixing(spark, sf_dir):
    return mixing.mix_table(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op3_lattice(spark, sf_dir):
    found = lattice.vector_links(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op4_quality_rules(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_rules.quality_verdicts(docs, labels).select(
        F.col("id").alias("doc_id"), *quality_rules.COUNTS, "base_failed", "kept")


def op5_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark, sf_dir):
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sentence_spans(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.sentence_span_dedup(docs).select(
        "doc_id", F.col("span_dedup.n_removed").cast("long").alias("n_removed"),
        F.col("span_dedup.spans").alias("removed_spans"), "text")


def op8_token_rollups(spark, sf_dir):
    """Load all documents, revise every count by the separator token that training adds,
    delete the documents labelled toxic, and replay the first batch, which does nothing."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    counted = written(bpe.count_tokens(docs.select("doc_id", "source", "lang", "text"), tokenizer_path())
                      .withColumn("tokenizer", F.lit(BPE_FILE.removesuffix(".json"))), "token-counts")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    rollup = token_rollups.TokenRollup(spark)
    load = counted.withColumn("op", F.lit("insert"))
    rollup.commit("load", load)
    rollup.commit("separators", counted.withColumn("op", F.lit("revise"))
                  .withColumn("n_tokens", F.col("n_tokens") + 1))
    rollup.commit("toxic", counted.join(toxic, "doc_id", "left_semi").withColumn("op", F.lit("delete")))
    rollup.commit("load", load)
    return rollup.totals()


def op9_license_scan(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select(
        "doc_id", F.array_join("license_scan.sentence_ids", ",").alias("sentence_ids"),
        F.array_join("license_scan.licenses", ",").alias("licenses"))


def op10_chat_format(spark, sf_dir):
    """All conversations, and one whose texts are made of control strings."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = turns.sparkSession.createDataFrame(
        [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_turns(turns.unionByName(extra), tokenizer_path())
    return chat_format.read_back(formatted, tokenizer_path()).drop("n_ids")


def op11_whitening(spark, sf_dir):
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return (found.withColumn("deviation", F.col("deviation").cast("long"))
            .withColumnRenamed("id", "vec_id"))


def op12_hard_negatives(spark, sf_dir):
    """Every label of a seventh of the rows moves on by one before anything else."""
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")),
                                         F.col("id") % 50 == 0)


def op13_quality_classifier(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_classifier.classify(docs, labels).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_lattice": op3_lattice,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_token_rollups": op8_token_rollups,
    "op9_license_scan": op9_license_scan,
    "op10_chat_format": op10_chat_format,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_classifier": op13_quality_classifier,
}
