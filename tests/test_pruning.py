"""Buckets without a query send no vectors to the shuffle; partitions follow the bytes."""

import math

import numpy as np
from pyspark.sql import functions as F

from annspark import SignFamily
from annspark.functions.hashing import signature_column
from annspark.operators.blocks import PARTITION_BYTES, ROW_OVERHEAD, partitions_for, with_queries_only
from tests.conftest import vectors_df


def _exploded(df, family, id_name):
    return (df.select(F.col("id").alias(id_name), signature_column(family, 8).alias("sig"))
            .select(id_name, F.posexplode_outer("sig").alias("tbl", "bucket")))


def test_buckets_without_a_query_are_dropped_and_no_partner_is(spark):
    rng = np.random.default_rng(5)
    train = vectors_df(spark, [(i, v, 0) for i, v in enumerate(rng.standard_normal((800, 8)))])
    query = vectors_df(spark, [(i, v, 0) for i, v in enumerate(rng.standard_normal((5, 8)))])
    for bits, few in ((30, True), (3, False)):
        family = SignFamily(4, bits)
        t, q = _exploded(train, family, "t_id"), _exploded(query, family, "q_id")
        partners = {tuple(r) for r in t.join(q, ["tbl", "bucket"]).select("t_id", "tbl", "bucket").collect()}
        for limit in (100_000, 40, 0):
            kept = {tuple(r) for r in with_queries_only(t, q, 4, limit).select("t_id", "tbl", "bucket").collect()}
            assert partners <= kept
            if few and limit == 100_000:
                assert len(kept) < 20  # of 3200 rows


def test_partitions_follow_rows_and_width(spark):
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(spark, 1000, 64) == configured
    for rows, width in ((10 ** 9, 64), (10 ** 9, 3072), (10 ** 7, 3072)):
        n = partitions_for(spark, rows, width)
        assert n == math.ceil(rows * (width * 8 + ROW_OVERHEAD) / PARTITION_BYTES)
        assert rows / n * (width * 8) <= PARTITION_BYTES
    assert partitions_for(spark, 10 ** 9, 64, 4) < partitions_for(spark, 10 ** 9, 64)
