"""Row samples: the first n rows in key order, and a Bernoulli sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head_sample(df: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """First ``n`` rows by ``order_col`` (A6): a distributed top-n, no trip to the driver."""
    return df.orderBy(order_col).limit(n)


def hash_sample(df: DataFrame, fraction: float, id_col: str = "id", seed: int = 1234) -> DataFrame:
    """Rows whose key hashes below ``fraction`` (A7): the same rows under any partitioning
    and on every run, and those of a smaller fraction are among those of a larger one.

    The hash is the first 60 bits of the MD5 of ``seed:id``, so any engine can repeat the
    draw. Rows with a null key are taken together, by the hash of the empty text."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be in 0..1")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.where(draw < F.lit(int(fraction * (1 << 60))))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 1234) -> DataFrame:
    """Sample without replacement (A7); fraction 1.0 keeps every row."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
