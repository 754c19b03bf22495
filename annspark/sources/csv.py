"""CSV vectors (one numeric column per component) and CSV ground-truth id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annspark.functions.vectors import assemble, pack_longs
from annspark.sources.positions import with_position


def component_names(width: int, prefix: str = "f") -> list[str]:
    return [f"{prefix}{i}" for i in range(width)]


def write_csv_vectors(df: DataFrame, path: str, width: int, id_col: str | None = "id",
                      features: str = "features", header: bool = True) -> None:
    cols = [F.col(id_col)] if id_col else []
    # Written as double: a float's shortest text would read back as another double.
    cols += [F.col(features)[i].cast("double").alias(name)
             for i, name in enumerate(component_names(width))]
    df.select(*cols).write.mode("overwrite").option("header", header).csv(path)


def read_csv_vectors(spark: SparkSession, path: str, width: int | None = None,
                     id_col: str | None = "id", header: bool = True) -> DataFrame:
    """``id, features array<double>`` from a CSV with one column per component.

    ``id_col=None`` reads files without an id column: ids are positions in the files (B6).
    With ``width`` the schema is explicit (no inference pass over the data); without it
    types are inferred, as the reference does.
    """
    reader = spark.read.option("header", header)
    if width is not None:
        fields = [T.StructField(id_col, T.LongType())] if id_col else []
        fields += [T.StructField(n, T.DoubleType()) for n in component_names(width)]
        df = reader.schema(T.StructType(fields)).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    comps = [c for c in df.columns if c != id_col]
    if id_col is None:
        df, id_col = with_position(df, "_id"), "_id"
    return df.select(F.col(id_col).cast("long").alias("id"), assemble(comps).alias("features"))


def write_ground_truth(lists: DataFrame, path: str, k: int, query_col: str = "query_id",
                       list_col: str = "neighbours", with_query: bool = True) -> None:
    """One headerless row per query: the query id, then its k neighbour ids.

    ``with_query=False`` writes the neighbour ids alone, rows in query order: the layout
    whose row position is the query id."""
    if not with_query:
        lists = lists.orderBy(query_col)
    cols = ([F.col(query_col)] if with_query else []) + [F.col(list_col)[i].alias(f"n{i}") for i in range(k)]
    lists.select(*cols).write.mode("overwrite").option("header", False).csv(path)


def read_ground_truth(spark: SparkSession, path: str, k: int | None = None,
                      with_query: bool = True, gt_base: int = 0) -> DataFrame:
    """``query_id long, neighbours array<bigint>`` from a headerless CSV.

    ``with_query=False``: the file holds neighbour ids only, and a row's 0-based position
    is its query id. ``gt_base`` is the number the file gives the first training row
    (0 or 1); it is subtracted, so neighbour ids are 0-based.
    """
    reader = spark.read.option("header", False)
    if k is not None:
        fields = [T.StructField(f"_c{i}", T.LongType()) for i in range(k + with_query)]
        df = reader.schema(T.StructType(fields)).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    if with_query:
        first, rest = df.columns[0], df.columns[1:]
    else:
        first, rest = "_id", df.columns
        df = with_position(df, first)
    return df.select(F.col(first).cast("long").alias("query_id"),
                     pack_longs([F.col(c).cast("long") - gt_base for c in rest]).alias("neighbours"))
