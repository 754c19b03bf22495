"""Batches bounded by candidate pairs, a log to resume from, and member lists of buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annspark import SignFamily, knn_join
from annspark.operators.batches import BatchedSearch, pack
from annspark.operators.index import bucket_index, bucket_postings, flatten_postings
from tests.conftest import vectors_df

FAMILY = SignFamily(3, 2)


def rows(df):
    return sorted((r.q_id, r.rn, r.t_id, r.t_label, r.n_candidates, round(r.distance, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the training rows, and half of the queries, share one bucket per table."""
    rng = np.random.default_rng(1)
    t = [(k, np.ones(6) if k % 3 == 0 else rng.normal(size=6), k % 4) for k in range(600)]
    q = [(k, np.ones(6) * 1.1 if k % 2 else rng.normal(size=6), 0) for k in range(80)]
    return vectors_df(spark, q), vectors_df(spark, t)


def test_batches_stay_under_their_bound_and_resume(spark, sides, tmp_path):
    q, t = sides
    bound, path = 6_000, str(tmp_path / "job")
    first = BatchedSearch(q, t, FAMILY, 4, max_pairs=bound, path=path)
    plan = first.plan().toPandas()
    want = {r.q_id: 0 for r in q.select(F.col("id").alias("q_id")).collect()}
    held = {(r.tbl, r.bucket): r["count"] for r in bucket_index(t, FAMILY).groupBy("tbl", "bucket").count().collect()}
    for r in bucket_index(q, FAMILY).collect():
        want[r.id] += held.get((r.tbl, r.bucket), 0)
    assert dict(zip(plan.q_id, plan.n_pairs)) == want
    assert plan.n_pairs.max() < bound / 2  # no query alone over half the bound
    assert plan.groupby("batch").n_pairs.sum().max() <= bound and plan.batch.nunique() > 5
    assert first.run(max_batches=3) == 3
    partial = rows(first.results())
    assert partial and {r[0] for r in partial} == set(plan[plan.batch.isin(sorted(plan.batch.unique())[:3])].q_id)
    # A batch that died half-way: its files are there, its log row is not.
    left = sorted(set(plan.batch) - {0, 1, 2})
    spark.range(5).write.parquet(f"{path}/results/batch-{left[0]}")
    again = BatchedSearch(q, t, FAMILY, 4, max_pairs=bound, path=path)
    assert rows(again.results()) == partial
    again.run()
    assert again.run() == 0
    assert rows(again.results()) == rows(knn_join(q, t, FAMILY, 4))


def test_nothing_to_search(sides):
    q, t = sides
    run = BatchedSearch(q.limit(0), t, FAMILY, 4)
    assert run.run() == 0 and run.results().count() == 0


def test_packing_by_running_sums(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(k) * 7, int(n)) for k, n in enumerate(rng.integers(0, 50, size=3000))]
    got = pack(spark.createDataFrame(pairs, "q_id long, n_pairs long").repartition(9), 400, slots=8).toPandas()
    upto, want = 0, {}
    for q, n in pairs:
        want[q], upto = upto // 200, upto + n
    assert dict(zip(got.q_id, got.batch)) == want and got.groupby("batch").n_pairs.sum().max() <= 400


def test_posting_lists_are_bounded_and_come_back(spark, sides):
    _, t = sides
    lists = bucket_postings(t, FAMILY, list_ids=8).cache()
    widths = lists.select(F.array_max(F.transform("lists", lambda p: F.size(p["offsets"]))).alias("w"),
                          F.size("lists").alias("n")).agg(F.max("w"), F.max("n")).first()
    assert widths[0] == 8 and widths[1] <= 16  # 200 rows share a bucket
    for r in lists.collect():
        for p in r.lists:
            assert p.offsets[0] == 0 and p.offsets == sorted(p.offsets)
        firsts = [p.first for p in r.lists]
        assert firsts == sorted(firsts) and sum(len(p.offsets) for p in r.lists) == r.n_members
    got = sorted(tuple(r) for r in flatten_postings(lists).collect())
    assert got == sorted((r.tbl, r.bucket, r.id) for r in bucket_index(t, FAMILY).collect())
    assert flatten_postings(bucket_postings(t.limit(0), FAMILY, 6)).count() == 0
    spread = bucket_postings(t, FAMILY, list_ids=8, max_broadcast_rows=0)
    assert sorted(tuple(r) for r in flatten_postings(spread).collect()) == got
