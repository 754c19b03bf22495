"""Scores: accuracy, share of matching neighbours, strict majority, recall@k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annspark.operators.classify import same_label
from annspark.operators.sweeps import sweep, sweep_sign  # noqa: F401 - scores too


def _share(part, whole):
    """``part / whole`` as a double; 0 of 0 (no queries) is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def accuracy(predictions: DataFrame) -> DataFrame:
    """``n, hits, accuracy`` from ``label, prediction`` (E8, E9, E12): one aggregate."""
    hit = same_label(predictions, "label", "prediction").cast("long")
    return predictions.agg(F.count(F.lit(1)).alias("n"),
                           F.coalesce(F.sum(hit), F.lit(0)).alias("hits"),
                           _share(F.coalesce(F.sum(hit), F.lit(0)), F.count(F.lit(1))).alias("accuracy"))


def _query_labels(query: DataFrame, id_col: str, label: str) -> DataFrame:
    return query.select(F.col(id_col).cast("long").alias("q_id"),
                        F.col(label).alias("q_label"))


def match_share(neighbours: DataFrame, query: DataFrame, id_col: str = "id",
                label: str = "label") -> DataFrame:
    """``q_id, n_neighbours, n_match, share``: share of neighbours with the query's label."""
    m = neighbours.join(_query_labels(query, id_col, label), "q_id")
    m = m.withColumn("_m", same_label(m, "t_label", "q_label").cast("long"))
    return m.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_neighbours"),
                                 F.sum("_m").alias("n_match"),
                                 F.avg("_m").alias("share"))


def strict_majority_accuracy(neighbours: DataFrame, query: DataFrame, id_col: str = "id",
                             label: str = "label") -> DataFrame:
    """Share of ALL queries whose neighbours match their label in more than half.

    Queries without neighbours count as misses. ``n_queries, n_majority, accuracy``.
    """
    shares = match_share(neighbours, query, id_col, label)
    q = query.select(F.col(id_col).cast("long").alias("q_id"))
    won = F.coalesce((F.col("share") > 0.5).cast("long"), F.lit(0))
    return (q.join(shares, "q_id", "left")
            .agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum(won), F.lit(0)).alias("n_majority"),
                 _share(F.sum(won), F.count(F.lit(1))).alias("accuracy")))


def truth_from_lists(ground_truth: DataFrame, query_col: str = "query_id",
                     list_col: str = "neighbours") -> DataFrame:
    """Ground-truth id lists (nearest first) as long rows ``q_id, t_id, rn``."""
    return ground_truth.select(F.col(query_col).cast("long").alias("q_id"),
                               F.posexplode(list_col).alias("_pos", "t_id")) \
        .select("q_id", F.col("t_id").cast("long"), (F.col("_pos") + 1).alias("rn"))


def recall_at_k(pred: DataFrame, truth: DataFrame, query: DataFrame, k: int,
                gt_depth: int | None = None, id_col: str = "id") -> DataFrame:
    """``k, n_queries, hits, recall``: found true neighbours over ``k * n_queries``.

    ``pred`` and ``truth`` are long rows ``q_id, t_id, rn``. Truth is cut to ``gt_depth``
    (default k, standard recall@k). The intersect of the two lists is an equi-join on
    ``(q_id, t_id)``; hits and the query count come out of one aggregate.
    """
    depth = k if gt_depth is None else gt_depth
    hits = (pred.where(F.col("rn") <= k).select("q_id", "t_id")
            .join(truth.where(F.col("rn") <= depth).select("q_id", "t_id"), ["q_id", "t_id"])
            .select(F.lit(1).alias("_hit"), F.lit(0).alias("_q")))
    queries = query.select(F.lit(0).alias("_hit"), F.lit(1).alias("_q"))
    both = hits.unionByName(queries)
    hits_n, queries_n = (F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("_hit", "_q"))
    return both.agg(F.lit(k).alias("k"), queries_n.alias("n_queries"), hits_n.alias("hits"),
                    _share(hits_n, F.lit(k) * queries_n).alias("recall"))
