"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes inserts documents with their token counts, deletes them, or revises a
count (or the source or language it stands under). Every change becomes signed rows: what
the ledger holds of the document is taken back, what the change says is added. Signed rows
are summed map-side into the batch's delta, and totals are the sum of all deltas. The ledger
lies in ``PARTS`` parts by a hash of the key, and a batch reads the parts of its own keys
alone: it never recounts documents it does not name.

Commits are idempotent. A batch writes its signed rows and its delta to folders named after
it, and last one row into the commit log. Only logged batches are read, so a batch that
died half-way counts for nothing and is written over when it is tried again; a batch that
is logged is not applied again. After every ``FOLD`` batches ledger and deltas are summed into
one folder, logged in the same way, which stands for all batches before it: what a batch
opens does not grow with the number of batches.

Nulls and ties. Source, language and tokenizer may be null and are groups of their own; a
null count is 0. A key is a (doc_id, tokenizer), null ids included, and may stand for several
documents: rows that share an id, and rows without one, each count. A batch's rows of a key
are told apart by operation only: of revise, insert and delete the strongest, in this order,
counts, and all rows with it become what the key stands for from then on, one document a
row, equal rows included. So inserting a key that is already there replaces it; deleting one
that is not there does nothing; other operations are refused. An empty batch is logged and
changes nothing. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annspark.llm.common import attach, plain_key, written
from annspark.session import scratch_path

KEYS = ["source", "lang", "tokenizer"]
RANK = {"delete": 0, "insert": 1, "revise": 2}
PARTS = 64
FOLD = 16
# ``seq`` counts log rows; a row with ``folds`` stands for all rows up to that number.
LOG = "batch string, n_changes long, seq long, folds long"
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, part int"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
FOLDED = "folded-"


class TokenRollup:
    """Totals kept under ``path`` (a shared folder; a fresh scratch folder if not given)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "token-rollup")
        spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{self.path}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def _live(self) -> list[tuple]:
        """``(batch, seq)`` of the log rows not folded yet: ``FOLD`` and one at most, and what
        a fold that died has left to the next commit."""
        folded = self.log().agg(F.max("folds")).first()[0]
        rows = self.log().where(F.col("seq") > F.lit(-1 if folded is None else folded))
        return sorted((r["batch"], r["seq"]) for r in rows.select("batch", "seq").distinct().collect())

    def _read(self, part: str, schema: str) -> DataFrame:
        read = self.spark.read.schema(schema)
        found = [read.parquet(f"{self.path}/{part}/{batch}") for batch, _ in self._live()]
        return reduce(DataFrame.unionByName, found, self.spark.createDataFrame([], schema))

    def ledger(self, parts: list[int] | None = None) -> DataFrame:
        """``doc_id, source, lang, tokenizer, docs, tokens, part`` of the documents counted,
        of all parts or of some."""
        rows = self._read("ledger", LEDGER)
        if parts is not None:
            rows = rows.where(F.col("part").isin(parts))
        return (rows.groupBy("part", "doc_id", *KEYS)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0"))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``; groups without documents are left out."""
        return (self._read("deltas", DELTA).groupBy(*KEYS)
                .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (``op, doc_id, source, lang, tokenizer, n_tokens``) as ``batch``.
        False, and nothing done, if that batch is in the log."""
        if not batch or batch.startswith(FOLDED) or any(c in batch for c in "/\\:*?[]{}"):
            raise ValueError(f"batch {batch!r} can't name a folder")
        if not self.log().where(F.col("batch") == batch).isEmpty():
            return False
        rank = F.lit(None).cast("int")
        for op, r in RANK.items():
            rank = F.when(F.col("op") == op, F.lit(r)).otherwise(rank)
        rank = F.coalesce(rank, F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null"))))
                          .cast("int"))
        change = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "tokenizer", rank.alias("rank"),
            F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))
        named = F.concat(plain_key("doc_id"), F.lit("|"), plain_key("tokenizer"))
        change = change.withColumn("key", named).withColumn(
            "part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
        change = written(change, "changes")
        keys = written(change.groupBy("part", "key", "doc_id", "tokenizer").agg(
            F.max("rank").alias("top"), F.min("rank").alias("low")), "changed-keys")
        # Only keys with several operations need to be looked up; a key may be hot.
        several = keys.where("top <> low").select("key", "top")
        strongest = attach(change, several, "key", F.xxhash64("tokens", "source", "lang"))
        plus = (strongest.where("rank > 0 and rank = coalesce(top, rank)")
                .groupBy("doc_id", *KEYS, "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))
        parts = [r[0] for r in keys.select("part").distinct().collect()]  # at most PARTS
        before = self.ledger(parts).withColumnsRenamed({"doc_id": "_d", "tokenizer": "_t", "part": "_p"})
        minus = (before.join(keys.select("part", "doc_id", "tokenizer"),
                             (F.col("_p") == F.col("part")) & F.col("_d").eqNullSafe(F.col("doc_id"))
                             & F.col("_t").eqNullSafe(F.col("tokenizer")))
                 .select("doc_id", "source", "lang", "tokenizer", "part", (-F.col("docs")).alias("docs"),
                         (-F.col("tokens")).alias("tokens")))
        columns = [f.split()[0] for f in LEDGER.split(", ")]
        n = self._write(batch, plus.select(*columns).unionByName(minus.select(*columns)))
        self._logged(batch, n)
        self._fold()
        return True

    def _write(self, name: str, signed: DataFrame) -> int:
        """Signed rows by part, and their sums, under ``name``; the number of rows."""
        at = f"{self.path}/ledger/{name}"
        # One writer a part, so a part of a batch is one file.
        signed.repartition(PARTS, "part").write.mode("overwrite").partitionBy("part").parquet(at)
        signed = self.spark.read.schema(LEDGER).parquet(at)
        (signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.path}/deltas/{name}"))
        return signed.count()

    def _logged(self, name: str, n: int, folds: int | None = None) -> None:
        last = self.log().agg(F.max("seq")).first()[0]
        (self.spark.createDataFrame([(name, n, 0 if last is None else last + 1, folds)], LOG)
         .coalesce(1).write.mode("append").parquet(f"{self.path}/log"))

    def _fold(self) -> None:
        live = self._live()
        if len(live) > FOLD:
            last = max(seq for _, seq in live)
            name = f"{FOLDED}{last}"
            columns = [f.split()[0] for f in LEDGER.split(", ")]
            self._logged(name, self._write(name, self.ledger().select(*columns)), last)
