"""k-NN classification: majority vote over neighbours, and the bucket-vote classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annspark.functions.hashing import signature_column
from annspark.functions.vectors import search_width, usable_rows, vector_column
from annspark.operators.blocks import DEFAULT_MAX_BROADCAST_ROWS, join_checked
from annspark.operators.index import bucket_histogram
from annspark.operators.search import knn_join

NO_PREDICTION = -1  # fixed value: prediction of a query without any candidate


def _queries(query: DataFrame, id_col: str, label: str | None) -> DataFrame:
    cols = [F.col(id_col).cast("long").alias("q_id")]
    if label is not None and label in query.columns:
        cols.append(F.col(label).alias("label"))
    return query.select(*cols)


def no_prediction(kind: T.DataType) -> Column:
    """-1 in the type of the training labels; null where the type has no such value."""
    if isinstance(kind, (T.NumericType, T.StringType)):
        return F.lit(NO_PREDICTION).cast(kind)
    return F.lit(None).cast(kind)


def same_label(df: DataFrame, a: str, b: str) -> Column:
    """Whether two label columns are equal; text against another type compares as text."""
    texts = [isinstance(df.schema[c].dataType, T.StringType) for c in (a, b)]
    if texts[0] != texts[1]:
        return F.col(a).cast("string") == F.col(b).cast("string")
    return F.col(a) == F.col(b)


def vote(neighbours: DataFrame, query: DataFrame, id_col: str = "id",
         label: str = "label") -> DataFrame:
    """Majority label of each query's neighbours.

    Order: most votes, then the nearest neighbour of the label, then the smaller label.
    Every query of ``query`` gets a row; without neighbours the prediction is -1 (D7).
    Labels may have any type; predictions have the training labels' type.
    Returns ``q_id, label, prediction, n_candidates``.
    """
    per_label = (neighbours.groupBy("q_id", "t_label")
                 .agg(F.count(F.lit(1)).alias("votes"), F.min("distance").alias("nearest"),
                      F.max("n_candidates").alias("n_cand")))
    order = Window.partitionBy("q_id").orderBy(F.desc("votes"), "nearest", "t_label")
    best = (per_label.withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") == 1)
            .select("q_id", F.col("t_label").alias("prediction"), "n_cand"))
    return _attach(best, query, id_col, label)


def _attach(best: DataFrame, query: DataFrame, id_col: str, label: str) -> DataFrame:
    q = _queries(query, id_col, label)
    out = q.join(best, "q_id", "left")
    cols = ["q_id"]
    if "label" in q.columns:
        cols.append("label")
    return out.select(
        *cols,
        F.coalesce(F.col("prediction"), no_prediction(best.schema["prediction"].dataType)).alias("prediction"),
        F.coalesce(F.col("n_cand"), F.lit(0)).cast("long").alias("n_candidates"))


def knn_classify(query: DataFrame, train: DataFrame, family=None, k: int = 5,
                 threshold: float | None = None, exclude_self: bool = False,
                 id_col: str = "id", label: str = "label", **opts) -> DataFrame:
    """Search, re-rank by distance, vote of the top k (H2, H5; exact with family=None)."""
    neighbours = knn_join(query, train, family, k, threshold, exclude_self,
                          id_col=id_col, label=label, **opts)
    return vote(neighbours, query, id_col, label)


def exact_classify(query: DataFrame, train: DataFrame, k: int = 5,
                   exclude_self: bool = False, **opts) -> DataFrame:
    """Exact k-NN classifier (H6)."""
    return knn_classify(query, train, None, k, None, exclude_self, **opts)


def bucket_vote_classify(query: DataFrame, train: DataFrame, family,
                         width: int | None = None, exclude_self: bool = False,
                         id_col: str = "id", label: str = "label", features: str = "features",
                         max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Label histogram vote without distances (H4).

    Each query adds up the label counts of its bucket in every table (bag semantics: a
    training row found in three tables counts three times) and takes the top label
    (order: votes, then smaller label). ``n_candidates`` is that bag size. With
    ``exclude_self`` (training rows scoring themselves) the row's own label is taken
    out once per table.
    """
    w = width or search_width(train, query, col=features)
    hist = bucket_histogram(train, family, w, id_col=id_col, features=features, label=label)
    hist = hist.withColumnRenamed("label", "t_label")
    q_cols = [F.col(id_col).cast("long").alias("q_id"),
              signature_column(family, w, vector_column(query, features)).alias("sig")]
    if exclude_self:
        q_cols.append(F.col(label).alias("_own"))
    qb = (query.where(usable_rows(query, features)).select(*q_cols)
          .select("*", F.posexplode_outer("sig").alias("tbl", "bucket")).drop("sig"))
    joined = join_checked(qb, hist, ["tbl", "bucket"], "inner", max_broadcast_rows,
                          spread_col="q_id")
    cnt = F.col("cnt")
    if exclude_self:
        cnt = cnt - F.when(F.col("t_label") == F.col("_own"), 1).otherwise(0)
    votes = (joined.withColumn("cnt", cnt).where(F.col("cnt") > 0)
             .groupBy("q_id", "t_label").agg(F.sum("cnt").alias("votes")))
    by_q = Window.partitionBy("q_id")
    best = (votes
            .withColumn("n_cand", F.sum("votes").over(by_q))
            .withColumn("_r", F.row_number().over(by_q.orderBy(F.desc("votes"), "t_label")))
            .where(F.col("_r") == 1)
            .select("q_id", F.col("t_label").alias("prediction"), "n_cand"))
    return _attach(best, query, id_col, label)
