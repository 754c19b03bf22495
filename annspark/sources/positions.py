"""Row ids from the position in a table's files, for files without a key column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annspark.operators.blocks import join_checked
from annspark.session import checkpoint_dir


def with_position(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``df`` (a plain file read) with consecutive 0-based ids: files in path order, rows
    in file order, however the files are cut into splits.

    The read is pinned once by a reliable checkpoint with each row's file, split start and
    position in its task. Rows of a split keep file order, so a split's offset (a running
    sum over one row per split) plus the position inside the split is the position in the
    table. That one-row-per-split table is broadcast if it is proven small.
    """
    checkpoint_dir(df.sparkSession)
    cols = df.columns
    pinned = (df.select("*", F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_pos"))
              .checkpoint(eager=True))
    splits = pinned.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"),
                                                   F.min("_pos").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start",
                            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return (join_checked(pinned, offsets, ["_file", "_start"], "inner", spread_col="_pos")
            .select(*cols, (F.col("_pos") + F.col("_off")).alias(id_col)))
