import pytest
from pyspark.sql import functions as F

from annspark.functions.vectors import assign_batches, mint_ids, pad
from annspark.session import scratch_path
from annspark.sources import (
    bernoulli_sample,
    head_sample,
    load_embeddings,
    load_pair,
    read_csv_vectors,
    read_ground_truth,
    read_libsvm,
    write_csv_vectors,
    write_ground_truth,
    write_libsvm,
)
from tests.conftest import SF001, vectors_df


def test_libsvm_short_width_padding_and_error(spark):
    train = vectors_df(spark, [(1, [1.0, 0.0, 2.5], 1), (2, [0.0, 3.0, 0.0], 0)])
    test = vectors_df(spark, [(3, [4.0, 0.5], 1)])
    tp, sp = scratch_path(spark, "t-train"), scratch_path(spark, "t-test")
    write_libsvm(train, tp)
    write_libsvm(test, sp)
    tr, te = load_pair(spark, tp, sp)
    assert [r["features"] for r in te.collect()] == [[4.0, 0.5, 0.0]]
    assert sorted(r["features"] for r in tr.collect()) == [[0.0, 3.0, 0.0], [1.0, 0.0, 2.5]]
    wide = vectors_df(spark, [(4, [1.0, 1.0, 1.0, 1.0], 0)])
    wp = scratch_path(spark, "t-wide")
    write_libsvm(wide, wp)
    with pytest.raises(Exception):
        read_libsvm(spark, wp, 3).collect()


def test_libsvm_bz2_round_trip(spark):
    df = load_embeddings(spark, SF001)
    path = scratch_path(spark, "t-bz2")
    write_libsvm(df, path, compression="bzip2")
    import os
    files = [f for f in os.listdir(path.replace("file:", "")) if f.endswith(".bz2")]
    assert files
    back = read_libsvm(spark, path, 64)
    a = sorted((float(r["label"]), tuple(r["features"])) for r in back.collect())
    b = sorted((float(r["label"]), tuple(r["features"])) for r in df.collect())
    assert a == b


def test_csv_round_trip_and_ground_truth(spark):
    df = vectors_df(spark, [(1, [0.1, 0.2], 0), (2, [1e-9, -3.0], 1)])
    path = scratch_path(spark, "t-csv")
    write_csv_vectors(df, path, 2)
    for width in (2, None):
        back = {r["id"]: r["features"] for r in read_csv_vectors(spark, path, width).collect()}
        assert back == {1: [0.1, 0.2], 2: [1e-9, -3.0]}
    lists = spark.createDataFrame([(10, [3, 1, 2]), (11, [2, 2, 1])], "query_id long, neighbours array<long>")
    gp = scratch_path(spark, "t-gt")
    write_ground_truth(lists, gp, 3)
    for k in (3, None):
        got = {r["query_id"]: r["neighbours"] for r in read_ground_truth(spark, gp, k).collect()}
        assert got == {10: [3, 1, 2], 11: [2, 2, 1]}


def test_pad(spark):
    df = vectors_df(spark, [(1, [1.0, 2.0], 0)])
    assert df.select(pad("features", 4)).first()[0] == [1.0, 2.0, 0.0, 0.0]
    with pytest.raises(Exception):
        df.select(pad("features", 1)).collect()


def test_mint_ids_consecutive_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = mint_ids(df, ["k"], "row_id", num_partitions=6).collect()
    got = sorted((r["k"], r["row_id"]) for r in out)
    assert [r for _, r in got] == list(range(1000))


def test_samples(spark):
    df = load_embeddings(spark, SF001)
    assert [r["id"] for r in head_sample(df, 5).collect()] == [0, 1, 2, 3, 4]
    assert bernoulli_sample(df, 1.0).count() == df.count()


def test_small_query_set_still_one_batch(spark):
    df = vectors_df(spark, [(i, [float(i)], 0) for i in range(7)])
    assert {r["batch"] for r in assign_batches(df, 1000).collect()} == {0}
    assert {r["batch"] for r in assign_batches(df, 3).collect()} == {0, 1, 2}
