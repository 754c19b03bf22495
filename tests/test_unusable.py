"""Null, NaN and infinite components, and values of any magnitude, never cost other rows."""

import numpy as np
import pyarrow as pa
import pytest

from annspark import SignFamily, knn_join
from annspark.functions.vectors import vector_width
from annspark.operators.blocks import BlockKernel
from annspark.operators.classify import bucket_vote_classify, knn_classify
from annspark.operators.index import build_index
from annspark.operators.search import exact_knn, knn_one, similarity_join

NAN, INF = float("nan"), float("inf")
SCHEMA = "id long, features array<double>, label int"
BAD = [(90, None, 0), (91, [NAN, 0.0], 0), (92, [INF, 0.0], 0), (93, [0.0, -INF], 0), (94, [None, 1.0], 0)]
GOOD = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, [5.0, 5.0], 1)]


def _lists(x):
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def _kernel(kernel, qx, tx):
    q = pa.table({"q_id": pa.array(np.arange(len(qx))), "q_vec": _lists(qx)})
    t = pa.table({"t_id": pa.array(np.arange(len(tx))), "t_vec": _lists(tx),
                  "t_label": pa.array(np.zeros(len(tx)))})
    return kernel(q, t).to_pydict()


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
@pytest.mark.parametrize("power", [-300, -30, 0, 18, 19, 20, 30, 160, 300])
def test_kernel_at_any_magnitude(power, dtype):
    if dtype is np.float32 and abs(power) > 30:
        pytest.skip("outside float32")
    rng = np.random.default_rng(3)
    qx, tx = rng.standard_normal((4, 8)), rng.standard_normal((50, 8))
    qx, tx = (qx * 10.0 ** power).astype(dtype), (tx * 10.0 ** power).astype(dtype)
    unit = 10.0 ** power
    diff = qx.astype(float)[:, None, :] / unit - tx.astype(float)[None, :, :] / unit
    want = np.sqrt((diff ** 2).sum(-1))
    res = _kernel(BlockKernel(3, None, False, False), qx, tx)
    assert res["t_id"] == [int(j) for row in want for j in np.argsort(row, kind="stable")[:3]]
    np.testing.assert_allclose(np.array(res["distance"]) / unit, np.sort(want, axis=1)[:, :3].ravel())
    near = _kernel(BlockKernel(None, 3.5 * unit, False, False), qx, tx)
    assert len(near["t_id"]) == int((want < 3.5).sum())


def test_one_huge_row_leaves_the_others_exact():
    tx = np.array([[0.0, 1.0], [0.5, 0.0], [1e200, 0.0], [0.25, 0.0]])
    res = _kernel(BlockKernel(3, None, False, False), np.array([[0.0, 0.0]]), tx)
    assert res["t_id"] == [3, 1, 0] and res["distance"] == [0.25, 0.5, 1.0]


def test_bad_rows_are_neither_queries_nor_candidates(spark):
    train = spark.createDataFrame(BAD + GOOD, SCHEMA)
    clean = spark.createDataFrame(GOOD, SCHEMA)
    fam = SignFamily(2, 2)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    for family in (None, fam):
        assert rows(knn_join(train, train, family, 3)) == rows(knn_join(clean, clean, family, 3))
    assert rows(similarity_join(train, train, fam, 2.0)) == rows(similarity_join(clean, clean, fam, 2.0))
    assert rows(knn_one(train, [0.0, 0.0], fam, 3)) == rows(knn_one(clean, [0.0, 0.0], fam, 3))
    assert rows(build_index(train, fam)) == rows(build_index(clean, fam))
    for pred in (knn_classify(train, train, fam, 3), bucket_vote_classify(train, train, fam)):
        got = {r["q_id"]: r["prediction"] for r in pred.collect()}
        assert len(got) == 9 and all(got[i] == -1 for i in range(90, 95))
        assert all(got[i] != -1 for i in range(1, 5))


def test_tables_without_a_usable_vector(spark):
    bad = spark.createDataFrame(BAD, SCHEMA)
    fam = SignFamily(2, 2)
    assert exact_knn(bad, bad, 3).collect() == [] and knn_join(bad, bad, fam, 3).collect() == []
    assert {r["prediction"] for r in bucket_vote_classify(bad, bad, fam).collect()} == {-1}


def test_width_is_the_largest_of_the_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [1.0], 0), (3, [1.0, 2.0, 3.0], 0)], SCHEMA)
    assert vector_width(df) == 3
    with pytest.raises(ValueError, match="width unknown"):
        vector_width(df.where("id = 1"))
