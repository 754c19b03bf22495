"""Helpers shared by the operators: written intermediates, rows' keys, checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annspark.operators.blocks import collect_if_small, salted_join
from annspark.session import scratch_path

# Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_BROADCAST_ROWS = 10_000


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared scratch folder and read back:
    lineage is cut, lost executors cost nothing, and the planner knows the size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` for helper columns, with underscores put before those that a column of
    ``df`` has already (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, also those whose names hold dots or other marks."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_key(col: str = "text") -> Column:
    """Hash of a row's text: with the id it tells rows that share an id apart."""
    return F.xxhash64(F.col(quoted(col)))


def plain_key(col: str) -> Column:
    """A column as a never-null string: equal where the column is null-safe equal, so a
    join on it and a grouping by it share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), F.col(quoted(col)).cast("string")), F.lit(""))


def attach(big: DataFrame, small: DataFrame, key: str, spread: Column,
           max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left join of a per-key table whose keys may be hot in ``big``: broadcast when the
    table is proven to have at most ``max_rows`` rows, else a salted shuffle join. Null
    keys match null keys."""
    safe = plain_key(key)
    big = big.withColumn("_at", safe)
    small = small.withColumn("_at", safe).drop(key)
    local = collect_if_small(small, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), "_at", "left").drop("_at")
    salted = salted_join(big.withColumn("_spread", spread), small, ["_at"], "left", "_spread")
    return salted.drop("_at", "_spread")
