"""Nearest-neighbour search: LSH k-NN join, similarity join, exact k-NN, one-key search.

Inputs are vector tables ``id long, features array<numeric>, label``. The query side
needs no label. ``family=None`` means exact search (every training row is a candidate).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annspark.functions.hashing import arrow_matrix, check_family, project, signature_column
from annspark.functions.sparse import distances_to, is_sparse
from annspark.functions.vectors import search_width, usable_rows, vector_column
from annspark.operators.blocks import (
    DEFAULT_BLOCK_ROWS,
    DEFAULT_MAX_BROADCAST_ROWS,
    EXACT_BLOCK_BYTES,
    JOIN_BLOCK_ROWS,
    JOIN_MOST_ROWS,
    BlockKernel,
    block_size,
    count_rows,
    exact_grid,
    lsh_blocks,
    partitions_for,
    run_blocks,
    uniform_blocks,
    with_queries_only,
)
from annspark.operators.topk import merge_top_k

# Fixed value: the reference's distance cut is 2.5 per vector dimension.
THRESHOLD_PER_DIMENSION = 2.5


def reference_threshold(width: int) -> float:
    """The reference's default distance threshold for vectors of ``width`` components."""
    return THRESHOLD_PER_DIMENSION * width


def _sides(query: DataFrame, train: DataFrame, id_col: str, features: str, label: str,
           train_sig: str | None = None):
    # A row without a usable vector has no neighbours and is no candidate (classifiers
    # still report such a query, with prediction -1).
    if is_sparse(query, features) != is_sparse(train, features):
        raise ValueError("query and training vectors must both be sparse or both be arrays")
    query = query.where(usable_rows(query, features))
    train = train.where(usable_rows(train, features))
    q = query.select(F.col(id_col).cast("long").alias("q_id"),
                     vector_column(query, features).alias("q_vec"))
    # A plain search table may have no label: null labels then. Labels keep their type.
    t_label = F.col(label) if label in train.columns else F.lit(None).cast("double")
    t_cols = [F.col(id_col).cast("long").alias("t_id"),
              vector_column(train, features).alias("t_vec"),
              t_label.alias("t_label")]
    if train_sig is not None:
        t_cols.append(F.col(train_sig).alias("t_sig"))
    return q, train.select(*t_cols)


def candidate_blocks(query: DataFrame, train: DataFrame, family, kernel_k: int | None,
                     threshold: float | None = None, exclude_self: bool = False,
                     block_rows: int | None = None,
                     max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                     width: int | None = None, counts: tuple[int, int] | None = None,
                     id_col: str = "id", features: str = "features",
                     label: str = "label", train_sig: str | None = None,
                     near_first: bool = False) -> tuple[DataFrame, int]:
    """Kernel output over all blocks, ``q_id, t_id, t_label, distance, n_cand``, and its
    number of partitions.

    ``block_rows`` bounds a block's rows a side, as long as a table is cut into few blocks
    (``block_size``); without it LSH blocks start at ``DEFAULT_BLOCK_ROWS`` and exact ones
    take ``EXACT_BLOCK_BYTES`` of vectors. Where all pairs are returned blocks grow to
    ``JOIN_MOST_ROWS`` rows a side at most.
    ``width`` (vector width) and ``counts`` (query rows, training rows) may be passed
    in by callers that already know them; otherwise each costs one small job.
    ``train_sig`` names a signature column already on ``train`` (an index hashed once
    with the same family by ``build_index``), so repeated searches do not hash the
    training table again.
    """
    q, t = _sides(query, train, id_col, features, label, train_sig)
    spark = query.sparkSession
    # Rows without a usable vector count too: these are upper bounds from an id-only scan.
    n_q, n_t = (counts if counts is not None
                else count_rows(query.select(id_col), train.select(id_col)))
    w = width or search_width(train, query, col=features)
    values, value_bytes = _row_size(train, features, w)
    if kernel_k is None:
        block_rows = block_rows or min(JOIN_MOST_ROWS, block_size(JOIN_BLOCK_ROWS, max(n_q, n_t),
                                                                  values * value_bytes))
    elif block_rows or family is not None:
        block_rows = block_size(block_rows or DEFAULT_BLOCK_ROWS, max(n_q, n_t), values * value_bytes)
    if family is None:
        rows = block_rows or max(DEFAULT_BLOCK_ROWS, int(EXACT_BLOCK_BYTES // max(1, values * value_bytes)))
        n_tb, n_qb = exact_grid(rows, 2 * spark.sparkContext.defaultParallelism, n_q, n_t)
        q_side, t_side = uniform_blocks(q, t, n_tb, n_qb)
        keys = ["tblock", "qblock"]
        kernel = BlockKernel(kernel_k, threshold, exclude_self, first_table=False, near_first=near_first)
        shuffled_rows = n_q * n_tb + n_t * n_qb
    else:
        q = q.withColumn("q_sig", signature_column(family, w, "q_vec"))
        if "t_sig" in t.columns:
            check_family(train, train_sig, family, w)
        else:
            t = t.withColumn("t_sig", signature_column(family, w, "t_vec"))
        # The _outer form: a plain posexplode makes Catalyst infer ``size(sig) > 0`` and
        # push it below the projection, which runs the hashing UDF twice. Signatures
        # are never empty, so the rows are the same.
        # Each exploded row keeps only the buckets of the EARLIER tables (all the
        # first-shared-table test needs): on average half the signature bytes shuffled.
        q_exp = (q.select("*", F.posexplode_outer("q_sig").alias("tbl", "bucket"))
                 .withColumn("q_sig", F.slice("q_sig", 1, F.col("tbl"))))
        t_exp = (t.select("*", F.posexplode_outer("t_sig").alias("tbl", "bucket"))
                 .withColumn("t_sig", F.slice("t_sig", 1, F.col("tbl"))))
        t_exp = with_queries_only(t_exp, q_exp, family.n_tables, max_broadcast_rows)
        q_side, t_side, added = lsh_blocks(q_exp, t_exp, block_rows, max_broadcast_rows, n_q, n_t)
        keys = ["tbl", "bgroup", "tblock", "qblock"]
        kernel = BlockKernel(kernel_k, threshold, exclude_self, first_table=True, near_first=near_first)
        # Exploded rows and the copies of split buckets: an upper bound, since training
        # rows of buckets without a query are dropped before the shuffle.
        shuffled_rows = (n_q + n_t) * family.n_tables + added
    n_tasks = partitions_for(spark, shuffled_rows, values, value_bytes)
    return run_blocks(q_side, t_side, keys, kernel, n_tasks), n_tasks


def _row_size(df: DataFrame, features: str, width: int) -> tuple[float, int]:
    """Values shuffled with a row and bytes of each; of sparse rows their mean number of
    entries, from one pass over the indices."""
    kind = df.schema[features].dataType.simpleString()
    if not is_sparse(df, features):
        return width, 4 if "float" in kind else 8
    entries = df.agg(F.avg(F.size(F.col(features)["indices"]))).first()[0] or 0.0
    return float(entries), 12


def knn_join(query: DataFrame, train: DataFrame, family=None, k: int = 5,
             threshold: float | None = None, exclude_self: bool = False, **opts) -> DataFrame:
    """k nearest candidates of every query.

    Returns ``q_id, t_id, t_label, distance, rn, n_candidates`` with ``rn`` in 1..k
    (order: distance, then t_id) and ``n_candidates`` the number of distinct
    candidates of the query within the threshold. Queries without candidates have no
    rows (classifiers add them back with prediction -1).
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    raw, n_tasks = candidate_blocks(query, train, family, k, threshold, exclude_self, **opts)
    return merge_top_k(raw, k, n_tasks)


def exact_knn(query: DataFrame, train: DataFrame, k: int = 5, exclude_self: bool = False,
              threshold: float | None = None, **opts) -> DataFrame:
    """Exact k nearest neighbours (the yardstick), as blocks of a query x train grid."""
    return knn_join(query, train, None, k, threshold, exclude_self, **opts)


def similarity_join(query: DataFrame, train: DataFrame, family, threshold: float | str | None = "reference",
                    exclude_self: bool = False, **opts) -> DataFrame:
    """Pairs that share a bucket in at least one table and lie within ``threshold``: by
    default the reference's cut for the vectors' width. An explicit None asks for every
    pair of every shared bucket.

    Each pair once: ``q_id, t_id, t_label, distance``. ``near_first=True`` hands on the pairs
    of large blocks by distance: where distances are rounded and written, files take about half
    the bytes.
    """
    if threshold == "reference":
        opts.setdefault("width", search_width(train, query, col=opts.get("features", "features")))
        threshold = reference_threshold(opts["width"])
    raw, _ = candidate_blocks(query, train, family, None, threshold, exclude_self, **opts)
    return raw.select("q_id", "t_id", "t_label", "distance")


def _to_key(vectors: pa.Array, key: np.ndarray) -> np.ndarray:
    if pa.types.is_struct(vectors.type):
        return distances_to(vectors, key)
    diff = arrow_matrix(vectors, len(key)) - key[None, :]
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def knn_one(train: DataFrame, key, family=None, k: int = 5, id_col: str = "id",
            features: str = "features", label: str = "label",
            train_sig: str | None = None) -> DataFrame:
    """k nearest rows to ONE key vector: ``id, label, distance, rn``.

    The key is one vector (a few KB) held in the closure. With a family, only training
    rows that share a bucket with the key in some table are scored (C4). The top k is a
    sort + limit, planned as a partial top-k per partition and a bounded merge.
    """
    kv = np.asarray(key, dtype=np.float64).ravel()
    width = len(kv)
    t_cols = [F.col(id_col).cast("long").alias("id"),
              vector_column(train, features).alias("features"), F.col(label).alias("label")]
    if train_sig is not None:
        t_cols.append(F.col(train_sig).alias("_sig"))
    t = train.where(usable_rows(train, features)).select(*t_cols)
    if family is not None and train_sig is not None:
        check_family(train, train_sig, family, width)
    ksig = None if family is None else family.signatures(kv[None, :]).reshape(-1)
    planes = None if family is None or train_sig is not None else family.planes(width)
    if ksig is not None and train_sig is not None:
        # Prebuilt index: the shared-bucket test is a plain JVM filter on its column.
        shared = None
        for j, b in enumerate(ksig.tolist()):
            cond = F.element_at("_sig", j + 1) == F.lit(int(b))
            shared = cond if shared is None else (shared | cond)
        t = t.where(shared).drop("_sig")

    @F.arrow_udf("double")
    def _dist(v: pa.Array) -> pa.Array:
        # One pass: distance to the key, null where no bucket is shared (hashed here
        # when there is no index).
        d = _to_key(v, kv)
        if planes is None:
            return pa.array(d)
        shared = (family.buckets(project(v, width, family.directions(planes))) == ksig[None, :]).any(axis=1)
        return pa.array(d, mask=~shared)

    # Non-deterministic only to the optimizer: it keeps the null filter above the UDF
    # instead of copying the UDF into a pushed-down filter (two Python passes).
    top = (t.withColumn("distance", _dist.asNondeterministic()("features"))
           .where(F.col("distance").isNotNull())
           .orderBy("distance", "id")
           .limit(k))
    # k rows at most: a window over them is bounded by the argument.
    return top.select("id", "label", "distance",
                      F.row_number().over(Window.orderBy("distance", "id")).alias("rn"))


def knn_one_indexed(spark, index_path: str, key, family, k: int = 5) -> DataFrame:
    """k nearest indexed rows to ONE key vector, reading only the key's buckets.

    ``index_path`` comes from ``build_bucket_index`` with the same family. Per table one
    read with ``tbl = j`` (partition pruning) and ``bucket = b_j`` (pushed to Parquet);
    a row found in several tables is kept only at the first one (its stored signature
    tells), so the union needs no distinct. Returns ``id, label, distance, rn``.
    """
    kv = np.asarray(key, dtype=np.float64).ravel()
    width = len(kv)
    ksig = family.signatures(kv[None, :]).reshape(-1).tolist()
    index = spark.read.parquet(index_path)
    check_family(index, "sig", family, width)
    parts = []
    for j, b in enumerate(ksig):
        first_here = F.lit(True)
        for i in range(j):  # not already found through an earlier table
            first_here = first_here & (F.element_at("sig", i + 1) != F.lit(int(ksig[i])))
        parts.append(index.where((F.col("tbl") == j) & (F.col("bucket") == F.lit(int(b))))
                     .where(first_here).select("id", "features", "label"))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)

    @F.arrow_udf("double")
    def _dist(v: pa.Array) -> pa.Array:
        return pa.array(_to_key(v, kv))

    top = cand.withColumn("distance", _dist("features")).orderBy("distance", "id").limit(k)
    return top.select("id", "label", "distance",
                      F.row_number().over(Window.orderBy("distance", "id")).alias("rn"))
