"""The mergeable top k: bounded arrays per query and task, no window over block rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annspark import SignFamily, exact_knn, knn_join
from annspark.operators.search import candidate_blocks
from annspark.operators.topk import merge_top_k, pack_top_k
from annspark.sources import load_embeddings, split_query_train
from tests.conftest import SF001

K = 5


@pytest.fixture(scope="module")
def sides(spark):
    return split_query_train(load_embeddings(spark, SF001))


@pytest.mark.parametrize("block_rows", [32, 64, 2048])
@pytest.mark.parametrize("family", [None, SignFamily(4, 3)])
def test_rows_into_the_last_exchange(sides, block_rows, family):
    """One row of at most k entries per query and map task, at any block size."""
    q, t = sides
    raw, n_tasks = candidate_blocks(q, t, family, K, block_rows=block_rows)
    packed = pack_top_k(raw, K).withColumn("task", F.spark_partition_id()).cache()
    per_task = packed.groupBy("q_id", "task").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("best")).alias("w"))
    assert per_task.agg(F.max("n"), F.max("w")).first()[:] == (1, K)
    assert packed.groupBy("q_id").count().agg(F.max("count")).first()[0] <= n_tasks
    packed.unpersist()


@pytest.mark.parametrize("block_rows", [32, 2048])
def test_no_window_in_searches(sides, block_rows):
    q, t = sides
    for nb in (knn_join(q, t, SignFamily(4, 3), K, block_rows=block_rows), exact_knn(q, t, K, block_rows=block_rows)):
        plan = nb._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "MapInArrow" in plan


def _raw(spark, n=4000, queries=7, blocks=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(queries)), k, f"l{k % 3}", float(rng.integers(50)), int(rng.integers(3)))
            for k in range(n)]
    df = spark.createDataFrame(rows, "q_id long, t_id long, t_label string, distance double, n_cand long")
    return rows, df.repartition(blocks)


@pytest.mark.parametrize("fan_in", [2, 256])
def test_merge_equals_a_plain_ranking(spark, fan_in):
    rows, raw = _raw(spark)
    got = {}
    for r in merge_top_k(raw, K, 40, fan_in).collect():
        got.setdefault(r.q_id, []).append((r.rn, r.distance, r.t_id, r.t_label, r.n_candidates))
    for q in {r[0] for r in rows}:
        mine = sorted((d, t, label) for a, t, label, d, _ in rows if a == q)[:K]
        total = sum(n for a, *_, n in rows if a == q)
        assert sorted(got[q]) == [(k + 1, d, t, label, total) for k, (d, t, label) in enumerate(mine)]


def test_merge_of_nothing(spark):
    _, raw = _raw(spark)
    assert merge_top_k(raw.limit(0), K, 1).count() == 0
