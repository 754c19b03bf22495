"""Exact search by rings around pivots equals the plain one and skips far rings."""

import numpy as np
import pytest

from annspark import exact_knn, exact_knn_pruned
from annspark.operators.pruned import PrunedSearch
from tests.conftest import vectors_df


def clustered(n, seed, centres=12, width=16, spread=0.3, shift=0):
    rng = np.random.default_rng(seed)
    at = np.random.default_rng(99).normal(size=(centres, width)) * 10
    which = rng.integers(centres, size=n)
    x = at[which] + rng.normal(size=(n, width)) * spread
    return [(shift + k, x[k], int(which[k])) for k in range(n)]


def rows(df):
    return sorted((r.q_id, r.rn, r.t_id, r.t_label, round(r.distance, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    return vectors_df(spark, clustered(150, 1, shift=10_000)), vectors_df(spark, clustered(1500, 2))


def test_equals_plain_search_and_skips_rings(sides):
    q, t = sides
    search = PrunedSearch(q, t, 5, n_pivots=24, block_rows=64)
    assert rows(search.search()) == rows(exact_knn(q, t, 5))
    report = search.report().first()
    assert report.n_pairs == 150 * len(search.rings.n) and report.n_searched < report.n_pairs / 2
    compared = {r.q_id: r.n_compared for r in search.search().collect()}
    assert max(compared.values()) < 1500 / 2


@pytest.mark.parametrize("block_rows,n_pivots", [(16, 1), (16, 40), (4096, 5)])
def test_any_cut_gives_the_same(sides, block_rows, n_pivots):
    q, t = sides
    assert rows(exact_knn_pruned(q, t, 3, block_rows=block_rows, n_pivots=n_pivots)) == rows(exact_knn(q, t, 3))


def test_a_third_of_all_rows_are_copies(spark):
    """The copies' ring is cut into blocks; ties go to the smaller ids."""
    data = clustered(400, 3) + [(1000 + k, np.ones(16), 1) for k in range(200)]
    t = vectors_df(spark, data)
    q = vectors_df(spark, [(5000, np.ones(16), 1), (5001, np.ones(16) * 1.01, 1), *clustered(20, 4, shift=6000)])
    search = PrunedSearch(q, t, 4, block_rows=32)
    assert rows(search.search()) == rows(exact_knn(q, t, 4))
    blocks = search.train.groupBy("cell", "ring", "sub").count().toPandas()
    assert blocks["count"].max() < 4 * 32


def test_self_search_and_few_rows(spark, tiny_2d):
    q, t = tiny_2d
    assert rows(exact_knn_pruned(t, t, 2, exclude_self=True)) == rows(exact_knn(t, t, 2, exclude_self=True))
    assert rows(exact_knn_pruned(q, t, 50)) == rows(exact_knn(q, t, 50))
    assert exact_knn_pruned(q, t.limit(0), 2).count() == 0
    assert exact_knn_pruned(q.limit(0), t, 2).count() == 0


def test_huge_and_unusable_values(spark):
    t = vectors_df(spark, [(k, [k * 1e160, 1.0], 0) for k in range(40)] + [(50, [float("nan"), 1.0], 0)])
    q = vectors_df(spark, [(100, [3.4e160, 0.0], 0), (101, [0.0, 0.0], 0), (102, [float("inf"), 0.0], 0)])
    assert rows(exact_knn_pruned(q, t, 3, block_rows=4)) == rows(exact_knn(q, t, 3))


def test_rings_are_bounded(sides):
    q, t = sides
    search = PrunedSearch(q, t, 3, n_pivots=8, block_rows=8, max_rings=10)
    assert len(search.rings.n) <= 10 + 8
    assert rows(search.search()) == rows(exact_knn(q, t, 3))
