"""Vector helpers written as built-in Spark expressions (JVM side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annspark.functions.sparse import is_sparse


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double_array(c) -> Column:
    """Any numeric array (e.g. ``array<float>``) as ``array<double>``; exact for floats."""
    return _col(c).cast("array<double>")


def vector_column(df: DataFrame, name: str) -> Column:
    """The vector column as stored when it is sparse, float or double, else cast to double.

    ``array<float>`` stays float through scans and shuffles (half the bytes); the
    kernels widen it to float64 in numpy, which is exact.
    """
    if is_sparse(df, name):
        return F.col(name)
    field = df.schema[name].dataType
    element = getattr(field, "elementType", None)
    if isinstance(element, (T.FloatType, T.DoubleType)):
        return F.col(name)
    return to_double_array(name)


def to_ml_vector(c) -> Column:
    """``array<double>`` to an ml ``Vector`` (for ml estimators and the LibSVM writer)."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(_col(c))


def from_ml_vector(c) -> Column:
    """ml ``Vector`` (sparse or dense) to a dense ``array<double>``."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(_col(c))


def sqdist(a, b) -> Column:
    """Squared Euclidean distance of two equal-width arrays, in double."""
    diffs = F.zip_with(_col(a), _col(b),
                       lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a, b) -> Column:
    return F.sqrt(sqdist(a, b))


def vector_sum(c) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def vector_sq(c) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def nonzeros(c) -> Column:
    return F.size(F.filter(_col(c), lambda x: x != 0))


def usable_vector(c) -> Column:
    """True for a vector whose components are all numbers: not null, no null, NaN or
    infinite component. Rows without a usable vector have no neighbours, are no
    candidates and are in no bucket; classifiers report them with prediction -1."""
    v = _col(c)
    finite = F.forall(v, lambda x: F.abs(x.cast("double")) < F.lit(float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def usable_rows(df: DataFrame, name: str) -> Column:
    """``usable_vector`` for a column of arrays or of sparse vectors: of the latter size,
    indices and values are there, and all values are numbers."""
    if not is_sparse(df, name):
        return usable_vector(name)
    there = F.col(name).isNotNull() & F.col(name)["size"].isNotNull() & F.col(name)["indices"].isNotNull()
    return there & usable_vector(F.col(name)["values"])


def vector_width(df: DataFrame, col: str = "features") -> int:
    """The largest vector width of the table (B1), from one aggregate over its rows."""
    row = df.where(F.col(col).isNotNull()).agg(F.max(F.size(col)).alias("w")).first()
    if row["w"] is None:
        raise ValueError("empty vector table: width unknown")
    return int(row["w"])


def search_width(*tables: DataFrame, col: str = "features") -> int:
    """Width of the first usable vector of the first table that has one (1 if none has).

    Searches need no maximum: a row of any other width is an error when it is hashed or
    compared, so reading one row tells as much as a scan.
    """
    for df in tables:
        size = F.col(col)["size"] if is_sparse(df, col) else F.size(col)
        row = df.where(usable_rows(df, col)).select(size.alias("w")).first()
        if row is not None:
            return int(row["w"])
    return 1


def pad(c, width: int) -> Column:
    """Pad with zeros to ``width``; a wider vector is an error, as in the reference."""
    v = _col(c).cast("array<double>")
    missing = F.lit(width) - F.size(v)
    return F.when(
        F.size(v) > width,
        F.raise_error(F.concat(F.lit(f"vector wider than {width}: "), F.size(v).cast("string"))),
    ).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(missing, F.lit(0)))))


def assemble(cols) -> Column:
    """Numeric columns into one ``array<double>`` (the assembler step of a CSV source)."""
    return F.array(*[_col(c).cast("double") for c in cols])


def pack_longs(cols) -> Column:
    """Columns cast to long and packed into an array (ground-truth lists)."""
    return F.array(*[_col(c).cast("long") for c in cols])


def assign_batches(df: DataFrame, batch_size: int, id_col: str = "id",
                   out: str = "batch", n_rows: int | None = None) -> DataFrame:
    """Batch number ``id mod groups`` with ``groups = max(1, ceil(n / batch_size))``.

    At least one batch even when there are fewer rows than ``batch_size``.
    """
    n = df.count() if n_rows is None else n_rows
    groups = max(1, -(-n // max(1, batch_size)))
    return df.withColumn(out, F.pmod(F.col(id_col), F.lit(groups)).cast("long"))


def mint_ids(df: DataFrame, order_cols, id_col: str = "row_id",
             num_partitions: int | None = None) -> DataFrame:
    """Consecutive 0-based ids in the order of ``order_cols`` without a one-partition window.

    Range-partition on the order and sort inside partitions; that layout is pinned with
    a reliable checkpoint (shared checkpoint folder), because the range bounds come from
    a sample and two executions of the shuffle could cut the data differently. From the
    pinned layout: the count of each partition (one row per partition, so the offset
    table is bounded by the partition count and safe to broadcast) plus the position
    inside the partition. ``order_cols`` should be unique; ties keep arrival order.
    """
    from annspark.operators.blocks import partitions_for
    from annspark.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    # Rows of some 512 bytes: the partition count grows with the table.
    n = num_partitions or partitions_for(spark, df.count(), 64)
    order = [_col(c) for c in order_cols]
    ranged = (df.repartitionByRange(n, *order)
              .sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              # monotonically_increasing_id = (partition << 33) + position in partition
              .withColumn("_pos", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_pid").cast("long"), 33))
              .checkpoint(eager=True))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"),
    ).fillna(0, subset=["_off"])
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, F.col("_off") + F.col("_pos"))
            .drop("_pid", "_pos", "_off"))
