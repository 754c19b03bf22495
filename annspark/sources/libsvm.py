"""LibSVM text: ``label index:value ...``, 1-based ascending indices, zeros left out.

Written with Spark's text writer (optionally bzip2-compressed), read with Spark's own
``libsvm`` source, which decodes ``.bz2`` by file extension.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annspark.functions.sparse import sparse_vector
from annspark.sources.positions import with_position


def libsvm_line(label="label", features="features"):
    """One LibSVM line per row, built from built-in expressions."""
    entries = F.transform(
        F.col(features),
        lambda x, i: F.when(x != 0, F.concat((i + 1).cast("string"), F.lit(":"),
                                             x.cast("double").cast("string"))))
    items = F.filter(entries, lambda e: e.isNotNull())
    return F.concat_ws(" ", F.col(label).cast("double").cast("string"), F.array_join(items, " "))


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features",
                 compression: str | None = None) -> None:
    writer = df.select(libsvm_line(label, features).alias("value")).write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None,
                id_col: str | None = None) -> DataFrame:
    """``label double, features array<double>``, dense.

    ``id_col`` adds the row's position in the files as its id (B6). With ``num_features`` every row is declared that wide (shorter rows are padded, a
    larger index is an error); without it the reader infers the width in an extra pass.
    """
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", int(num_features))
    df = reader.load(path)
    keys = []
    if id_col is not None:
        df, keys = with_position(df, id_col), [id_col]
    return df.select("label", vector_to_array("features").alias("features"), *keys)


def read_libsvm_sparse(spark: SparkSession, path: str, num_features: int | None = None,
                       id_col: str | None = None) -> DataFrame:
    """``label double, features`` as sparse vectors (``functions/sparse.py``), parsed by
    built-in expressions and never made dense. Text after ``#`` and empty lines do not
    count; an index below 1 or above ``num_features``, or one not above its predecessor, is
    an error. Arguments as in ``read_libsvm``."""
    width = num_features if num_features is not None else libsvm_width(spark, path)
    df = spark.read.text(path)
    keys = []
    if id_col is not None:
        df, keys = with_position(df, id_col), [id_col]
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    df = df.withColumn("_parts", F.split(line, r"\s+")).where(line != "")
    entries = F.filter(F.slice("_parts", 2, F.size("_parts")), lambda e: F.instr(e, ":") > 0)
    places = F.transform(entries, lambda e: F.substring_index(e, ":", 1).cast("int") - 1)
    values = F.transform(entries, lambda e: F.substring_index(e, ":", -1).cast("double"))
    df = df.select(F.element_at("_parts", 1).cast("double").alias("label"), places.alias("_i"),
                   values.alias("_v"), *keys)
    # One pass over the indices: the last one of an ascending row, or ``width`` from the first
    # wrong one on (looking neighbours up by position would parse the line once per entry).
    last = F.aggregate("_i", F.lit(-1), lambda at, i: F.when((i > at) & (i < F.lit(width)), i).otherwise(F.lit(width)))
    wrong = last >= F.lit(width)
    checked = F.when(F.coalesce(wrong, F.lit(False)),
                     F.raise_error(F.lit(f"indices must ascend within 1..{width}"))).otherwise(F.col("_i"))
    return df.select("label", sparse_vector(width, checked, F.col("_v")).alias("features"), *keys)


def libsvm_width(spark: SparkSession, path: str) -> int:
    """Largest index used in a LibSVM file: the vector width it implies (B1)."""
    lines = spark.read.text(path)
    last = F.element_at(F.split(F.trim(F.regexp_replace("value", "#.*", "")), " "), -1)
    idx = F.when(F.instr(last, ":") > 0, F.split(last, ":").getItem(0).cast("int")).otherwise(0)
    row = lines.agg(F.max(idx).alias("w")).first()
    return int(row["w"] or 0)


def load_pair(spark: SparkSession, train_path: str, test_path: str,
              num_features: int | None = None, sparse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test read with ONE width (A2): the given one, else the wider of the two.

    Rows get consecutive ids from their position in the files (B6), the same on every
    read, however the files are split. With ``sparse`` the vectors stay sparse.
    """
    width = num_features or max(libsvm_width(spark, train_path), libsvm_width(spark, test_path))
    read = read_libsvm_sparse if sparse else read_libsvm
    return read(spark, train_path, width, id_col="id"), read(spark, test_path, width, id_col="id")
