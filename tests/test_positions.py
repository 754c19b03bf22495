"""Position ids: consecutive, in file order, the same whatever the splits."""

import pytest

from annspark.session import scratch_path
from annspark.sources import load_pair, read_csv_vectors, read_ground_truth, write_libsvm
from tests.conftest import vectors_df


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_do_not_depend_on_splits(spark, split_size):
    df = vectors_df(spark, [(i, [float(i), 1.0], i % 3) for i in range(400)]).repartition(3).orderBy("id")
    path = scratch_path(spark, "pos-train")
    write_libsvm(df, path)
    seen = []
    for size in ("128m", "700", "97"):
        split_size(size)
        train, test = load_pair(spark, path, path, 2)
        for part in (train, test):
            seen.append({r["id"]: r["features"][0] for r in part.collect()})
    assert all(s == {i: float(i) for i in range(400)} for s in seen)


def test_ground_truth_without_a_query_column(spark):
    path = scratch_path(spark, "pos-gt")
    spark.createDataFrame([("7,3,9",), ("1,2,4",)], "value string").coalesce(1).write.text(path)
    for k in (3, None):
        got = read_ground_truth(spark, path, k, with_query=False)
        assert {r["query_id"]: r["neighbours"] for r in got.collect()} == {0: [7, 3, 9], 1: [1, 2, 4]}
    got = read_ground_truth(spark, path, 3, with_query=False, gt_base=1)
    assert {r["query_id"]: r["neighbours"] for r in got.collect()} == {0: [6, 2, 8], 1: [0, 1, 3]}


def test_csv_vectors_without_an_id_column(spark):
    path = scratch_path(spark, "pos-csv")
    spark.createDataFrame([("f0,f1",), ("1,2",), ("3,4.5",)], "value string").coalesce(1).write.text(path)
    for width in (2, None):
        got = read_csv_vectors(spark, path, width, id_col=None)
        assert {r["id"]: r["features"] for r in got.collect()} == {0: [1.0, 2.0], 1: [3.0, 4.5]}
    empty = scratch_path(spark, "pos-empty")
    spark.createDataFrame([("f0,f1",)], "value string").coalesce(1).write.text(empty)
    assert read_csv_vectors(spark, empty, 2, id_col=None).collect() == []
