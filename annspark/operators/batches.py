"""Batches of queries that bound the work of a search, with a log to resume from.

The label-free histogram of the training buckets tells how many candidate pairs each query
will meet. Queries, in the order of their ids, are packed so that a batch has at most
``max_pairs`` pairs (a query with more than half of that may add its own on top). Batches
run one after another against one bucketed index, which is built once and never shuffled.

A job costs seconds however few pairs it meets, so batches in a row are searched by one job, a
*round*, as long as they hold ``round_pairs`` pairs at most: the number of jobs follows the
pairs of the whole search and not the number of batches. A batch of more is a round of its own.

Everything lives under one folder: the index, the queries in order of their batches, the
results by round, and a log. The batches of a round are logged together after its results are
written, and only logged results are read, so a run that died goes on with the first batch
not logged and repeats none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annspark.functions.hashing import signature_column
from annspark.functions.vectors import search_width, usable_rows, vector_column
from annspark.operators.blocks import DEFAULT_BLOCK_ROWS, DEFAULT_MAX_BROADCAST_ROWS, join_checked
from annspark.operators.bucketed import BucketedIndex, build_bucketed_index
from annspark.session import scratch_path

MAX_PAIRS = 1_000_000_000
ROUND_PAIRS = 4_000_000_000
SLOTS = 256
_LOG = "name string, n long"


def pairs_per_query(query: DataFrame, index: BucketedIndex, family, id_col: str = "id", features: str = "features",
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``q_id, n_pairs``: training rows in the query's buckets, over all tables (E1 summed)."""
    width = index.manifest["width"]
    sizes = index.rows().groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    asked = (query.where(usable_rows(query, features))
             .select(F.col(id_col).cast("long").alias("q_id"),
                     signature_column(family, width, vector_column(query, features)).alias("sig"))
             .select("q_id", F.posexplode_outer("sig").alias("tbl", "bucket")))
    met = join_checked(asked, sizes, ["tbl", "bucket"], "left", max_broadcast_rows, "q_id")
    return met.groupBy("q_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_pairs"))


def pack(pairs: DataFrame, max_pairs: int, slots: int = SLOTS) -> DataFrame:
    """``q_id, n_pairs, batch``: running sums of ``n_pairs`` by id, cut at every half of
    ``max_pairs``. The sums run inside ranges of ids and over one row per range."""
    half = max(1, max_pairs // 2)
    at = [(k + 1) / slots for k in range(slots - 1)]
    cuts = pairs.agg(F.percentile_approx("q_id", F.array(*[F.lit(a) for a in at]), F.lit(10_000))).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    ranged = pairs.withColumn("_slot", F.size(F.filter(cuts, lambda c: c < F.col("q_id"))))
    sums = ranged.groupBy("_slot").agg(F.sum("n_pairs").alias("_n"))  # at most ``slots`` rows
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slot").orderBy("q_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_before") + F.coalesce(F.sum("n_pairs").over(inside), F.lit(0))
    return (ranged.join(F.broadcast(offsets), "_slot")
            .select("q_id", "n_pairs", F.floor(upto / half).cast("long").alias("batch")))


class BatchedSearch:
    """A search in batches under ``path`` (a fresh scratch folder if not given); opening it
    again with the same path goes on where it stopped."""

    def __init__(self, query: DataFrame, train: DataFrame, family, k: int = 5, max_pairs: int = MAX_PAIRS,
                 threshold: float | None = None, path: str | None = None, block_rows: int = DEFAULT_BLOCK_ROWS,
                 id_col: str = "id", features: str = "features", label: str = "label",
                 round_pairs: int = ROUND_PAIRS):
        self.spark, self.family, self.k, self.threshold = query.sparkSession, family, k, threshold
        self.round_pairs = round_pairs
        self.path = (path or scratch_path(self.spark, "batched-search")).rstrip("/")
        self.spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{self.path}/log")
        done = self.done()
        if "index" not in done:
            width = search_width(train, query, col=features)
            build_bucketed_index(train, family, f"{self.path}/index", width, block_rows, id_col, features, label).drop()
            self._log("index")
        self.index = BucketedIndex(self.spark, f"{self.path}/index")
        self.index.check(family, self.index.manifest["width"])
        if "plan" not in done:
            pairs = pairs_per_query(query, self.index, family, id_col, features)
            pack(pairs, max_pairs).write.mode("overwrite").parquet(f"{self.path}/plan")
            asked = query.select(F.col(id_col).cast("long").alias("q_id"), F.col(features).alias("features"))
            # Each file holds the queries of batches in a row: a round reads those of its own.
            (asked.join(self.plan().select("q_id", "batch"), "q_id").repartitionByRange("batch", "q_id")
             .sortWithinPartitions("batch").write.mode("overwrite").parquet(f"{self.path}/queries"))
            self._log("batch pairs", max(1, max_pairs // 2))
            self._log("plan", self.plan().agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0])

    def done(self) -> dict:
        rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect()  # a row per round
        return {r["name"]: r["n"] for r in rows}

    def _log(self, name: str, n: int = 0) -> None:
        (self.spark.createDataFrame([(name, n)], _LOG).coalesce(1)
         .write.mode("append").parquet(f"{self.path}/log"))

    def plan(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/plan")

    def run(self, max_batches: int | None = None) -> int:
        """Search the batches not logged yet (at most ``max_batches``); how many were."""
        done, ran = self.done(), 0
        at = max(self._rounds(done).values(), default=0)
        # A batch spans that many pairs of the running sum: those of a round hold no more than
        # ``round_pairs`` (and what its last query may add). Numbers without a query occur
        # where one query fills several batches.
        together = max(1, self.round_pairs // done["batch pairs"])
        left = done["plan"] - at if max_batches is None else min(done["plan"] - at, max_batches)
        while ran < left:
            n = min(together, left - ran)
            queries = (self.spark.read.parquet(f"{self.path}/queries")
                       .where((F.col("batch") >= at) & (F.col("batch") < at + n)))
            found = self.index.search(queries, self.family, self.k, self.threshold, id_col="q_id")
            found.write.mode("overwrite").parquet(f"{self.path}/results/from-batch-{at}")
            self._log(f"from batch {at}", at + n)
            at, ran = at + n, ran + n
        return ran

    def _rounds(self, done: dict) -> dict:
        """First batch and the one after the last of each logged round."""
        return {int(name.split()[-1]): n for name, n in done.items() if name.startswith("from batch ")}

    def results(self) -> DataFrame:
        """The neighbours of all logged batches, as ``knn_join`` gives them."""
        paths = [f"{self.path}/results/from-batch-{at}" for at in sorted(self._rounds(self.done()))]
        kind = self.index.rows().schema["t_label"].dataType.simpleString()
        schema = f"q_id long, t_id long, t_label {kind}, distance double, rn int, n_candidates long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)
