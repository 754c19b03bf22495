"""The bucketed index: no shuffle of its rows, a manifest that is checked."""

import re

import numpy as np
import pytest

from annspark import EuclideanFamily, SignFamily, knn_join, knn_one
from annspark.operators.bucketed import BucketedIndex, build_bucketed_index
from annspark.operators.index import build_bucket_index, build_index
from annspark.operators.search import knn_one_indexed
from annspark.sources import load_embeddings, split_query_train
from tests.conftest import SF001, vectors_df

FAMILY = SignFamily(4, 3)


def rows(df):
    return sorted((r.q_id, r.rn, r.t_id, r.t_label, r.n_candidates, round(r.distance, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    return split_query_train(load_embeddings(spark, SF001))


@pytest.fixture(scope="module")
def index(sides):
    return build_bucketed_index(sides[1], FAMILY, block_rows=32)


def test_search_equals_the_plain_join_again_and_again(sides, index):
    q, t = sides
    want = rows(knn_join(q, t, FAMILY, 5))
    assert rows(index.search(q, FAMILY, 5)) == want
    assert rows(index.search(q, FAMILY, 5, max_broadcast_rows=0)) == want  # lists too long to broadcast
    assert rows(index.search(q.where("id < 100"), FAMILY, 5)) == [r for r in want if r[0] < 100]
    assert rows(index.search(q, FAMILY, 5, threshold=1.3)) == rows(knn_join(q, t, FAMILY, 5, 1.3))
    assert index.search(q.limit(0), FAMILY, 5).count() == 0


def test_no_exchange_on_the_index_side(sides, index):
    found = index.search(sides[0], FAMILY, 5)
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    below = plan[plan.index("FlatMapCoGroupsInArrow"):].splitlines()
    # The second child of the cogroup, down to the scan of the index.
    depth = next(i for i, line in enumerate(below) if i and re.match(r"^\W*\+- ", line) and "Sort" in line)
    side = below[depth:]
    scan = next(i for i, line in enumerate(side) if "Bucketed: true" in line and "t_vec" in line)
    own = [line for line in side[:scan] if re.match(r"^\W*(:- |\+- )?\W*\*?(\(\d+\) )?\W*Exchange hash", line)]
    assert not own, "\n".join(side[:scan + 1])


def test_hot_buckets_are_cut(spark):
    t = vectors_df(spark, [(k, np.ones(4), k % 2) for k in range(300)] + [(900 + k, -np.ones(4), 1) for k in range(50)])
    q = vectors_df(spark, [(k, np.ones(4) * 2, 0) for k in range(20)])
    index = build_bucketed_index(t, SignFamily(2, 2), block_rows=16)
    assert index.hot().count() > 0
    assert index.rows().groupBy("tbl", "bucket", "tblock").count().agg({"count": "max"}).first()[0] < 64
    assert rows(index.search(q, SignFamily(2, 2), 3)) == rows(knn_join(q, t, SignFamily(2, 2), 3))


def test_opened_from_its_files(spark, sides, index):
    again = BucketedIndex(spark, index.path)
    assert again.manifest == index.manifest and again.table != index.table
    assert rows(again.search(sides[0], FAMILY, 2)) == rows(index.search(sides[0], FAMILY, 2))
    again.drop()
    assert index.rows().count() == sides[1].count() * 4


@pytest.mark.parametrize("wrong", [SignFamily(4, 3, seed=99), SignFamily(4, 4), SignFamily(5, 3), EuclideanFamily(0.1, 4)])
def test_another_family_is_an_error(spark, sides, index, wrong):
    q, t = sides
    key = q.first()["features"]
    with pytest.raises(ValueError, match="another hash family"):
        index.search(q, wrong, 5)
    hashed = build_index(t, FAMILY)
    with pytest.raises(ValueError, match="another hash family"):
        knn_join(q, hashed, wrong, 5, train_sig="sig")
    with pytest.raises(ValueError, match="another hash family"):
        knn_one(hashed, key, wrong, 5, train_sig="sig")
    assert knn_one(hashed, key, FAMILY, 5, train_sig="sig").count() == 5


def test_bucket_index_checks_its_family(spark, sides):
    q, t = sides
    path, key = build_bucket_index(t, FAMILY), q.first()["features"]
    assert knn_one_indexed(spark, path, key, FAMILY, 3).count() == 3
    with pytest.raises(ValueError, match="another hash family"):
        knn_one_indexed(spark, path, key, SignFamily(4, 3, seed=1), 3)


def test_empty_training_table(spark, sides):
    q, t = sides
    assert build_bucketed_index(t.limit(0), FAMILY, width=64).search(q, FAMILY, 3).count() == 0
