"""The LSH index as long tables: bucket members, label histograms, bucket sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annspark.functions.hashing import family_digest, signature_column
from annspark.functions.sparse import is_sparse
from annspark.functions.vectors import search_width, usable_rows, vector_column
from annspark.operators.blocks import DEFAULT_MAX_BROADCAST_ROWS, join_checked, partitions_for
from annspark.session import scratch_path


def bucket_index(train: DataFrame, family, width: int | None = None, id_col: str = "id",
                 features: str = "features", label: str = "label") -> DataFrame:
    """``tbl, bucket, id, label``: one row per training row and table (B12, E2 long form)."""
    w = width or search_width(train, col=features)
    train = train.where(usable_rows(train, features))
    sig = signature_column(family, w, vector_column(train, features))
    return (train.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"),
                         sig.alias("sig"))
            .select(F.posexplode_outer("sig").alias("tbl", "bucket"), "id", "label"))


def bucket_histogram(train: DataFrame, family, width: int | None = None, **cols) -> DataFrame:
    """``tbl, bucket, label, cnt``: label counts per bucket (E1), combined map-side."""
    return (bucket_index(train, family, width, **cols)
            .groupBy("tbl", "bucket", "label")
            .agg(F.count(F.lit(1)).alias("cnt")))


def bucket_summary(train: DataFrame, family, width: int | None = None, **cols) -> DataFrame:
    """``tbl, bucket, n_members, id_sum, id_min, id_max`` per bucket.

    Members stay in the long table of ``bucket_index``; a bucket is never gathered into
    one list, since one bucket may hold a large share of all rows.
    """
    return (bucket_index(train, family, width, **cols)
            .groupBy("tbl", "bucket")
            .agg(F.count(F.lit(1)).alias("n_members"), F.sum("id").alias("id_sum"),
                 F.min("id").alias("id_min"), F.max("id").alias("id_max")))


POSTING_IDS = 256  # ids of a list
POSTING_LISTS = 8  # lists of a row, on average


def bucket_postings(train: DataFrame, family, width: int | None = None, list_ids: int = POSTING_IDS,
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, **cols) -> DataFrame:
    """Member lists of the buckets (E2): ``tbl, bucket, part, n_members, lists``.

    ``lists`` holds sorted lists of at most ``list_ids`` members, each as its first id and
    the differences of all members to it. A bucket with more members than a row's share
    (``POSTING_LISTS`` lists) is spread over several rows by a hash of the id, so no row
    grows with the bucket. Ids are taken to be unique.
    """
    members = bucket_index(train, family, width, **cols).select("tbl", "bucket", "id")
    share = list_ids * POSTING_LISTS
    sizes = members.groupBy("tbl", "bucket").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    # Only buckets that need several rows are looked up.
    dealt = (join_checked(members, sizes.where("_parts > 1"), ["tbl", "bucket"], "left", max_broadcast_rows, "id")
             .withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")))
    rows = dealt.groupBy("tbl", "bucket", "part").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    starts = F.sequence(F.lit(1), F.size("_ids"), F.lit(list_ids))

    def one(start):
        ids = F.slice("_ids", start, F.lit(list_ids))
        first = F.get(ids, F.lit(0))
        return F.struct(first.alias("first"), F.transform(ids, lambda i: i - first).alias("offsets"))

    return rows.select("tbl", "bucket", "part", F.size("_ids").cast("long").alias("n_members"),
                       F.transform(starts, one).alias("lists"))


def flatten_postings(postings: DataFrame) -> DataFrame:
    """``tbl, bucket, id``: the members back from their lists."""
    ids = F.flatten(F.transform("lists", lambda p: F.transform(p["offsets"], lambda o: p["first"] + o)))
    return postings.select("tbl", "bucket", F.explode_outer(ids).alias("id"))


def build_index(train: DataFrame, family, path: str | None = None, width: int | None = None,
                id_col: str = "id", features: str = "features", label: str = "label",
                sig: str = "sig") -> DataFrame:
    """Hash the training table once and keep it as Parquet: ``id, features, label, sig``.

    Written to ``path`` or to a fresh folder under the shared checkpoint folder, and read
    back, so later searches (``knn_join``/``knn_one`` with ``train_sig="sig"``, streams)
    neither hash again nor depend on the input's lineage. Being columnar, the bucket
    sizing of a search reads only the ``sig`` column, not the vectors.
    """
    spark = train.sparkSession
    w = width or search_width(train, col=features)
    train = train.where(usable_rows(train, features))
    cols = [F.col(id_col).cast("long").alias(id_col), F.col(features).alias(features)]
    if label in train.columns:
        cols.append(F.col(label).alias(label))
    made = signature_column(family, w, vector_column(train, features))
    # The family's digest stays with the column, so searches can check theirs against it.
    hashed = train.select(*cols, made.alias(sig, metadata={"family": family_digest(family, w)}))
    out = path or scratch_path(spark, "lsh-index")
    hashed.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def build_bucket_index(train: DataFrame, family, path: str | None = None,
                       width: int | None = None, id_col: str = "id",
                       features: str = "features", label: str = "label",
                       num_partitions: int | None = None) -> str:
    """Long-form LSH index on disk for single-key lookups; returns its path.

    One row per (table, bucket, training row) with the vector and the full signature,
    written partitioned by ``tbl`` and range-sorted by ``(bucket, id)`` inside, so a
    lookup of one bucket per table reads one partition folder per table and Parquet
    statistics skip every row group without that bucket. The range includes ``id``, so
    a hot bucket is spread over many files instead of one. Storage is one copy of the
    vectors per table, the usual price of an LSH index.
    """
    spark = train.sparkSession
    w = width or search_width(train, col=features)
    train = train.where(usable_rows(train, features))
    values = w if not is_sparse(train, features) else 64
    n = num_partitions or partitions_for(spark, train.select(id_col).count() * family.n_tables, values)
    cols = [F.col(id_col).cast("long").alias("id"), F.col(features).alias("features"),
            (F.col(label) if label in train.columns else F.lit(None)).alias("label"),
            signature_column(family, w, vector_column(train, features)).alias(
                "sig", metadata={"family": family_digest(family, w)})]
    long = (train.select(*cols)
            .select("id", "features", "label", "sig", F.posexplode_outer("sig").alias("tbl", "bucket")))
    out = path or scratch_path(spark, "lsh-bucket-index")
    (long.repartitionByRange(n, "tbl", "bucket", "id")
     .sortWithinPartitions("tbl", "bucket", "id")
     .write.mode("overwrite").partitionBy("tbl").parquet(out))
    return out
