"""Parquet vector tables in the engine's contract ``id long, features array<double>, label``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annspark.functions.vectors import vector_column

# The test-data layout and its query/training split.
EMBEDDINGS = "embeddings.parquet"
QUERY_FOLDS = 5  # rows with id % 5 == 0 are queries, the others training rows


def load_vectors(spark: SparkSession, path: str, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Read a Parquet vector table; the column selection prunes the scan.

    Float and double vectors keep their stored type (float halves shuffle bytes and is
    widened exactly where arithmetic happens); other numeric arrays become double.
    """
    df = spark.read.parquet(path)
    cols = [F.col(id_col).cast("long").alias("id"), vector_column(df, vec_col).alias("features")]
    if label_col is not None:
        cols.append(F.col(label_col).alias("label"))
    return df.select(*cols)


def load_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_vectors(spark, f"{sf_dir.rstrip('/')}/{EMBEDDINGS}")


def split_query_train(df: DataFrame, folds: int = QUERY_FOLDS) -> tuple[DataFrame, DataFrame]:
    """Queries and training rows; together they are the whole table."""
    is_query = F.pmod(F.col("id"), F.lit(folds)) == 0
    return df.where(is_query), df.where(~is_query)
