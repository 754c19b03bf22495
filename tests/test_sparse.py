"""Sparse vectors from LibSVM text through hashing, search, votes and indexes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annspark import EuclideanFamily, SignFamily, bucket_vote_classify, exact_knn, knn_classify, knn_join, knn_one
from annspark.functions import sparse
from annspark.functions.vectors import usable_rows
from annspark.operators.blocks import BlockKernel
from annspark.operators.index import build_bucket_index, build_index
from annspark.operators.search import candidate_blocks, knn_one_indexed, similarity_join
from annspark.sources import load_pair, read_libsvm, read_libsvm_sparse, write_libsvm
from tests.conftest import vectors_df

SCHEMA = "id long, features struct<size:int,indices:array<int>,values:array<double>>, label int"


def _pair(spark, n=300, width=40, density=0.15, seed=1):
    """The same vectors as arrays and as sparse vectors."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < density)
    x[5] = 0.0
    dense = vectors_df(spark, [(k, x[k], k % 4) for k in range(n)])
    thin = dense.withColumn("features", sparse.to_sparse("features")).select("id", "features", "label")
    return dense, thin


def _split(df):
    return df.where("id % 5 = 0"), df.where("id % 5 <> 0")


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("family", [None, SignFamily(4, 3), EuclideanFamily(0.5, 3)])
def test_searches_equal_those_of_arrays(spark, family):
    (dq, dt), (sq, st) = map(_split, _pair(spark))
    assert _rows(knn_join(sq, st, family, 4)) == _rows(knn_join(dq, dt, family, 4))
    assert _rows(knn_classify(sq, st, family, 4)) == _rows(knn_classify(dq, dt, family, 4))
    if family is not None:
        assert _rows(similarity_join(sq, st, family, 2.0)) == _rows(similarity_join(dq, dt, family, 2.0))
        assert _rows(bucket_vote_classify(sq, st, family)) == _rows(bucket_vote_classify(dq, dt, family))


def test_one_key_and_indexes(spark):
    (dq, dt), (sq, st) = map(_split, _pair(spark))
    family, key = SignFamily(4, 3), dq.first()["features"]
    want = _rows(knn_one(dt, key, family, 5))
    assert _rows(knn_one(st, key, family, 5)) == want
    index = build_index(st, family)
    assert _rows(knn_one(index, key, family, 5, train_sig="sig")) == want
    assert _rows(knn_one_indexed(spark, build_bucket_index(st, family), key, family, 5)) == want
    assert _rows(knn_join(sq, index, family, 4, train_sig="sig")) == _rows(knn_join(dq, dt, family, 4))


def test_blocks_with_too_many_columns_are_halved(spark, monkeypatch):
    (dq, dt), (sq, st) = map(_split, _pair(spark))
    q, t = (df.select(F.col("id").alias(f"{p}_id"), F.col("features").alias(f"{p}_vec"),
                      *([F.col("label").alias("t_label")] if p == "t" else [])).toArrow()
            for df, p in ((sq, "q"), (st, "t")))
    monkeypatch.setattr(sparse, "DENSE_VALUES", 1500)
    parts = BlockKernel(3, None, False, False)(q, t).to_pandas()
    assert (parts.groupby("q_id").size() > 3).all()  # several blocks' worth of rows
    want = exact_knn(dq, dt, 3).toPandas().sort_values(["q_id", "rn"])
    best = parts.sort_values(["q_id", "distance", "t_id"]).groupby("q_id").head(3)
    assert best.t_id.tolist() == want.t_id.tolist() and np.allclose(best.distance, want.distance)
    assert parts.groupby("q_id").n_cand.sum().eq(dt.count()).all()


def test_a_wide_row_shuffles_few_bytes(spark):
    """50 entries in a million columns: under 2 kB for a row with its bucket and ids."""
    rng = np.random.default_rng(2)
    width, rows = 1_000_000, []
    for k in range(60):
        places = sorted(rng.choice(width, 50, replace=False).tolist())
        rows.append((k, (width, places, rng.normal(size=50).tolist()), k % 3))
    df = spark.createDataFrame(rows, SCHEMA)
    q, t = _split(df)
    raw, n_tasks = candidate_blocks(q, t, EuclideanFamily(0.05, 2), 3)
    shuffled = [p for p in _exchanged(raw) if "t_vec" in p[0]]
    assert shuffled and all(size < 2000 for _, size in shuffled)
    near = knn_join(q, t, None, 3).where("rn = 1").collect()
    x = {k: dict(zip(v[1], v[2])) for k, v, _ in rows}
    for r in near:
        def gap(i):
            a, b = x[r.q_id], x[i]
            return sum((a.get(c, 0) - b.get(c, 0)) ** 2 for c in {*a, *b}) ** 0.5
        best = min((round(gap(i), 9), i) for i in x if i % 5)
        assert (round(r.distance, 9), r.t_id) == best


def _exchanged(raw):
    """Columns and mean Arrow bytes of the rows below each cogroup input."""
    out = []
    for child in list_children(raw._jdf.queryExecution().analyzed()):
        df = raw.sparkSession.createDataFrame([], "a int").__class__(
            raw.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(raw.sparkSession._jsparkSession, child),
            raw.sparkSession)
        table = df.toArrow()
        out.append((table.column_names, table.nbytes / max(1, table.num_rows)))
    return out


def list_children(plan):
    children = plan.children()
    return [children.apply(i) for i in range(children.size())]


def test_reader_keeps_rows_sparse(spark, tmp_path):
    dense, _ = _pair(spark, 50)
    train, test = str(tmp_path / "train"), str(tmp_path / "test")
    write_libsvm(dense.orderBy("id"), train)
    write_libsvm(dense.where("id < 7").orderBy("id"), test)
    a, b = load_pair(spark, train, test, sparse=True)
    assert {f.name for f in a.schema["features"].dataType.fields} == {"size", "indices", "values"}
    back = {r.id: r for r in a.collect()}
    for r in read_libsvm(spark, train, back[0].features["size"], id_col="id").collect():
        mine, x = back[r.id].features, np.zeros(back[0].features["size"])
        x[mine["indices"]] = mine["values"]
        assert np.array_equal(x, r.features) and back[r.id].label == r.label
    assert b.count() == 7 and "vector" not in str(a._jdf.queryExecution().optimizedPlan())


def test_reader_of_comments_and_faults(spark, tmp_path):
    path = tmp_path / "rows.txt"
    path.write_text("# head\n1 2:0.5 4:1 # tail 9:9\n\n-1\n")
    rows = read_libsvm_sparse(spark, str(path), 4).orderBy("label").collect()
    assert [(r.label, r.features["indices"], r.features["values"]) for r in rows] == [
        (-1.0, [], []), (1.0, [1, 3], [0.5, 1.0])]
    assert read_libsvm_sparse(spark, str(path)).first().features["size"] == 4
    for fault in ("1 5:1\n", "1 0:1\n", "1 2:1 2:3\n", "1 3:1 2:3\n"):
        path.write_text(fault)
        with pytest.raises(Exception, match="ascend"):
            read_libsvm_sparse(spark, str(path), 4).collect()


def test_unusable_sparse_rows(spark):
    rows = [(1, (3, [0], [1.0]), 0), (2, None, 0), (3, (3, [0], [float("nan")]), 0), (4, (3, [0], [None]), 0),
            (6, (3, None, [1.0]), 0), (7, (3, [], []), 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.id for r in df.where(usable_rows(df, "features")).orderBy("id").collect()] == [1, 7]
    assert {r.t_id for r in exact_knn(df, df, 9).collect()} == {1, 7}
    dense = vectors_df(spark, [(1, [1.0, 0.0, 0.0], 0)])
    with pytest.raises(ValueError, match="both"):
        exact_knn(df, dense, 1)
