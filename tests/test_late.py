"""Late materialisation: the rows of ``knn_join`` from codes, bounds and one fetch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annspark import EuclideanFamily, SignFamily, knn_join, late_knn_join
from annspark.operators.late import LateSearch, decode, encode
from annspark.sources import load_embeddings, split_query_train
from tests.conftest import SF001, vectors_df


def rows(df):
    return sorted((r.q_id, r.rn, r.t_id, r.t_label, r.n_candidates, round(r.distance, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    return split_query_train(load_embeddings(spark, SF001))


@pytest.mark.parametrize("family,opts", [
    (SignFamily(8, 6), {}), (EuclideanFamily(0.1, 3), {"block_rows": 32, "max_broadcast_rows": 0}),
    (SignFamily(3, 1), {"block_rows": 64, "max_pairs": 1}), (SignFamily(3, 1), {"block_rows": 16, "max_pairs": 0})])
def test_same_rows_as_the_plain_join(sides, family, opts):
    q, t = sides
    assert rows(late_knn_join(q, t, family, 5, **opts)) == rows(knn_join(q, t, family, 5))


def test_vectors_are_shuffled_once(sides):
    """What is exploded per table holds no vector, and only rows of live buckets."""
    q, t = sides
    family = SignFamily(8, 6)
    search = LateSearch(q, t, family, 5)
    for p, side in (("q", search.q_codes), ("t", search.t_codes)):
        out = search.exploded(p)
        assert {"q_vec", "t_vec"}.isdisjoint(out.columns) and {"q_vec", "t_vec"}.isdisjoint(side.columns)
        assert out.agg(F.max(F.length("code"))).first()[0] == 64
        buckets = {(r.tbl, r.bucket) for r in out.select("tbl", "bucket").collect()}
        other = search.exploded("t" if p == "q" else "q").select("tbl", "bucket").distinct().collect()
        assert buckets == {(r.tbl, r.bucket) for r in other}  # no row without a partner, on either side
    kept = search.exploded("q").count() + search.exploded("t").count()
    assert kept < (q.count() + t.count()) * family.n_tables
    plan = search.search()
    plan.write.format("noop").mode("overwrite").save()
    text = plan._jdf.queryExecution().executedPlan().toString()
    # The only vectors in an exchange or broadcast are those of the two fetches by id.
    assert "bucket" not in text and text.count("FlatMapCoGroupsInArrow") == 0


def test_copies_and_near_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    near = [(k, base[k % 6] + rng.normal(size=8) * 1e-6, k % 3) for k in range(300)]
    same = [(1000 + k, base[0], 1) for k in range(200)]
    t, q = vectors_df(spark, near + same), vectors_df(spark, [(5000 + k, base[k] + 1e-7, 0) for k in range(6)])
    for opts in ({}, {"max_pairs": 2, "block_rows": 32}):
        assert rows(late_knn_join(q, t, SignFamily(2, 2), 4, **opts)) == rows(knn_join(q, t, SignFamily(2, 2), 4))
    few = LateSearch(q, vectors_df(spark, same), SignFamily(2, 2), 4).pairs()[0]
    assert few.where("t_id >= 0").groupBy("q_id").count().agg(F.max("count")).first()[0] <= 4


def test_self_search_edges_and_widths(spark, tiny_2d, sides):
    q, t = sides
    assert rows(late_knn_join(t, t, SignFamily(4, 3), 3, exclude_self=True)) == \
        rows(knn_join(t, t, SignFamily(4, 3), 3, exclude_self=True))
    q, t = tiny_2d
    assert rows(late_knn_join(q, t, SignFamily(3, 2), 9)) == rows(knn_join(q, t, SignFamily(3, 2), 9))
    for a, b in ((q.limit(0), t), (q, t.limit(0))):
        assert late_knn_join(a, b, SignFamily(3, 2), 2).count() == 0
    odd = vectors_df(spark, [(1, [0.0, 0.0], 0), (2, [1e200, -1e200], 1), (3, [float("nan"), 1.0], 0), (4, [1e-200, 0], 2)])
    assert rows(late_knn_join(q, odd, SignFamily(3, 1), 3)) == rows(knn_join(q, odd, SignFamily(3, 1), 3))


def test_codes_bound_what_they_leave_out():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 33)) * 10.0 ** rng.integers(-150, 150, size=(500, 1))
    x[0] = 0
    codes, scale, error = encode(x)
    import pyarrow as pa
    back = decode(pa.array([row.tobytes() for row in codes]), scale, 33)
    big = np.abs(x).max(axis=1, keepdims=True) + (np.abs(x).max(axis=1, keepdims=True) == 0)
    off = np.sqrt((((x - back) / big) ** 2).sum(axis=1))
    assert (off <= error / big[:, 0]).all() and (error / big[:, 0] < 0.03).all()
