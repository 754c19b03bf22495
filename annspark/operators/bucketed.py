"""An LSH index kept as a bucketed table: repeated batch searches shuffle no training rows.

One row per training row and table, laid out by Spark's own bucketing on the keys that a
search meets rows by: (table, group of buckets, block). A search hashes its queries, sends
them to the same layout and reads the index in place: there is no Exchange on its side. Blocks
are fixed when the index is built: a bucket with more than ``block_rows`` rows is cut by a
hash of the id, and the list of such buckets is stored beside the rows.

The manifest, one JSON text beside the rows, names the family by a digest of its planes, the
vector width, and the layout. Opening the index in another session defines the table again
from it; searching with another family or width is an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annspark.functions.hashing import family_digest, signature_column
from annspark.functions.sparse import is_sparse
from annspark.functions.vectors import search_width, usable_rows, vector_column
from annspark.operators.blocks import (
    DEFAULT_BLOCK_ROWS,
    DEFAULT_MAX_BROADCAST_ROWS,
    MERGE_ROWS,
    BlockKernel,
    block_size,
    KERNEL_SCHEMA,
    join_checked,
    partitions_for,
    with_queries_only,
)
from annspark.operators.topk import merge_top_k
from annspark.session import scratch_path

LAYOUT = ["tbl", "bgroup", "tblock"]


def _exploded(df: DataFrame, family, width: int, p: str) -> DataFrame:
    """A row per table, with the buckets of the earlier tables in ``{p}_sig``."""
    hashed = df.withColumn("sig", signature_column(family, width, f"{p}_vec"))
    return (hashed.select(*df.columns, "sig", F.posexplode_outer("sig").alias("tbl", "bucket"))
            .withColumn(f"{p}_sig", F.slice("sig", 1, F.col("tbl"))).drop("sig"))


def _grouped(df: DataFrame, n_groups: int) -> DataFrame:
    return df.withColumn("bgroup", F.pmod(F.xxhash64("bucket"), F.lit(n_groups)).cast("int"))


class BucketedIndex:
    """An index opened from ``path``; ``build_bucketed_index`` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        text = spark.read.option("wholetext", True).text(f"{self.path}/manifest").first()["value"]
        self.manifest = json.loads(text)
        self.table = f"ann_index_{uuid.uuid4().hex}"
        m = self.manifest
        spark.sql(f"CREATE TABLE {self.table} ({m['schema']}) USING parquet CLUSTERED BY ({', '.join(LAYOUT)}) "
                  f"INTO {m['n_parts']} BUCKETS LOCATION '{self.path}/rows'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def hot(self) -> DataFrame:
        """``tbl, bucket, n_tb`` of the buckets that are cut into blocks."""
        return self.spark.read.schema("tbl int, bucket long, n_tb int").parquet(f"{self.path}/hot")

    def check(self, family, width: int) -> None:
        if self.manifest["family"] != family_digest(family, width):
            raise ValueError("the index was built with another hash family or vector width")

    def candidates(self, query: DataFrame, family, k: int | None, threshold: float | None = None,
                   exclude_self: bool = False, id_col: str = "id", features: str = "features",
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, int]:
        """Kernel output of the queries against the index, and its partitions."""
        m = self.manifest
        self.check(family, m["width"])
        q = query.where(usable_rows(query, features)).select(
            F.col(id_col).cast("long").alias("q_id"), vector_column(query, features).alias("q_vec"))
        q = _grouped(_exploded(q, family, m["width"], "q"), m["n_groups"])
        t = with_queries_only(self.rows(), q, family.n_tables, max_broadcast_rows)
        q = (join_checked(q, self.hot(), ["tbl", "bucket"], "left", max_broadcast_rows, "q_id")
             .withColumn("tblock", F.explode(F.sequence(F.lit(0), F.coalesce("n_tb", F.lit(1)) - 1))).drop("n_tb"))
        kernel = BlockKernel(k, threshold, exclude_self, first_table=True)
        n = m["n_parts"]
        schema = KERNEL_SCHEMA.format(label=t.schema["t_label"].dataType.simpleString())
        return (q.repartition(n, *LAYOUT).groupBy(*LAYOUT).cogroup(t.groupBy(*LAYOUT))
                .applyInArrow(lambda a, b: kernel(a, b), schema)), n

    def search(self, query: DataFrame, family, k: int = 5, threshold: float | None = None,
               exclude_self: bool = False, **opts) -> DataFrame:
        """As ``knn_join``: ``q_id, t_id, t_label, distance, rn, n_candidates``. The queries of
        a block are held by one task: search very many queries in batches."""
        if k < 1:
            raise ValueError("k must be >= 1")
        raw, n = self.candidates(query, family, k, threshold, exclude_self, **opts)
        return merge_top_k(raw, k, n)

    def drop(self) -> None:
        """Forget the table's definition; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def build_bucketed_index(train: DataFrame, family, path: str | None = None, width: int | None = None,
                         block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = "id", features: str = "features",
                         label: str = "label", max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> BucketedIndex:
    """Build the index under ``path`` (a fresh scratch folder if not given) and open it."""
    spark = train.sparkSession
    path = (path or scratch_path(spark, "bucketed-index")).rstrip("/")
    w = width or search_width(train, col=features)
    t_label = F.col(label) if label in train.columns else F.lit(None).cast("double")
    t = train.where(usable_rows(train, features)).select(
        F.col(id_col).cast("long").alias("t_id"), vector_column(train, features).alias("t_vec"),
        t_label.alias("t_label"))
    n_rows = t.select("t_id").count()
    block_rows = block_size(block_rows, n_rows, 8 * (64 if is_sparse(train, features) else w))
    n_groups = max(1, -(-n_rows // min(MERGE_ROWS, block_rows)))
    rows = _grouped(_exploded(t, family, w, "t"), n_groups)
    sizes = rows.groupBy("tbl", "bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_tb"))
    (sizes.where("n_tb > 1").select("tbl", "bucket", "n_tb").write.mode("overwrite").parquet(f"{path}/hot"))
    hot = spark.read.schema("tbl int, bucket long, n_tb int").parquet(f"{path}/hot")
    n_tb = F.coalesce("n_tb", F.lit(1))
    rows = (join_checked(rows, hot, ["tbl", "bucket"], "left", max_broadcast_rows, "t_id")
            .withColumn("tblock", F.pmod(F.xxhash64("t_id"), n_tb).cast("int")).drop("n_tb")
            .select("t_id", "t_vec", "t_label", "t_sig", "bucket", *LAYOUT))
    n_parts = partitions_for(spark, n_rows * family.n_tables, 64 if is_sparse(train, features) else w)
    name = f"ann_build_{uuid.uuid4().hex}"
    # Dealt out by the layout first, so every bucket is one file.
    (rows.repartition(n_parts, *LAYOUT).write.mode("overwrite").bucketBy(n_parts, *LAYOUT)
     .option("path", f"{path}/rows").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is an external one
    manifest = {"family": family_digest(family, w), "kind": type(family).__name__, "width": w, "n_rows": n_rows,
                "n_groups": n_groups, "n_parts": n_parts, "block_rows": block_rows,
                "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)}
    (spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{path}/manifest"))
    return BucketedIndex(spark, path)
