"""Batches of queries in a row are searched by one job, and logged one round at a time (F2)."""

import os

import numpy as np

from annspark import SignFamily, knn_join
from annspark.operators.batches import BatchedSearch
from tests.conftest import vectors_df

FAMILY = SignFamily(2, 2)


def rows(df):
    return sorted((r.q_id, r.rn, r.t_id, r.n_candidates, round(r.distance, 9)) for r in df.collect())


def test_jobs_follow_the_pairs_and_not_the_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    t = vectors_df(spark, [(k, rng.normal(size=5), k % 4) for k in range(300)])
    q = vectors_df(spark, [(k, rng.normal(size=5), 0) for k in range(60)])
    want = rows(knn_join(q, t, FAMILY, 3))
    one = BatchedSearch(q, t, FAMILY, 3, max_pairs=100, path=str(tmp_path / "one"))
    assert one.plan().select("batch").distinct().count() > 20
    assert one.run() == one.done()["plan"] and one.run() == 0
    assert len(os.listdir(tmp_path / "one" / "results")) == 1 and rows(one.results()) == want
    some = BatchedSearch(q, t, FAMILY, 3, max_pairs=1_000, path=str(tmp_path / "some"), round_pairs=3_000)
    n = some.done()["plan"]
    assert some.run(max_batches=2) == 2
    again = BatchedSearch(q, t, FAMILY, 3, max_pairs=1_000, path=str(tmp_path / "some"), round_pairs=3_000)
    assert again.run() == n - 2 and rows(again.results()) == want
    assert len(os.listdir(tmp_path / "some" / "results")) == 1 + -(-(n - 2) // 6)
