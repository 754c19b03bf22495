"""All pairs of a join: each once, in few bytes, from blocks that grow with the table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from annspark import EuclideanFamily, similarity_join
from annspark.operators import blocks, search
from annspark.operators.blocks import BlockKernel
from annspark.plans.queries import _r, _r_pairs
from tests.conftest import SF001, vectors_df

ONE_BUCKET = EuclideanFamily(1e6, 1)


def side(p, vectors, ids, labels=None):
    n, width = vectors.shape
    vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(vectors.ravel()))
    cols = {f"{p}_id": pa.array(ids), f"{p}_vec": vec}
    return pa.table(cols | ({"t_label": pa.array(labels, pa.int32())} if p == "t" else {}))


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_pairs_near_first_are_the_same_pairs(monkeypatch, chunk):
    monkeypatch.setattr(blocks, "PAIR_ROWS", 100)
    rng = np.random.default_rng(3)
    q = side("q", rng.normal(size=(30, 5)).astype(np.float32), rng.permutation(30))
    t = side("t", rng.normal(size=(50, 5)).astype(np.float32), rng.permutation(50),
             [None if k % 7 == 0 else k for k in range(50)])

    def run(near_first, least, k=None):
        monkeypatch.setattr(blocks, "NEAR_FIRST_PAIRS", least)
        kernel = BlockKernel(k, 3.0, False, first_table=False, chunk_values=chunk, near_first=near_first)
        return [tuple(r.values()) for r in kernel(q, t).to_pylist()]

    plain, near, few = run(False, 1), run(True, 1), run(True, 10_000)
    assert len(plain) > 500 and sorted(map(str, near)) == sorted(map(str, plain))
    assert [r[3] for r in near] == sorted(r[3] for r in plain)
    assert few == plain  # too few pairs to share rounded distances: left by query
    assert run(True, 1, k=3) == run(False, 1, k=3)  # top k keeps its own order


def test_a_block_without_pairs():
    q = side("q", np.zeros((2, 3)), [1, 2])
    t = side("t", np.ones((3, 3)), [1, 2, 3], [0, 1, None])
    assert BlockKernel(None, 0.5, False, first_table=False, near_first=True)(q, t).num_rows == 0


def test_rounded_pairs_take_few_bytes(spark, tmp_path):
    """over nine bytes a pair were written, eight of them the distance."""
    rng = np.random.default_rng(9)

    def unit(n, shift):
        v = rng.normal(size=(n, 64))
        v = v / np.linalg.norm(v, axis=1)[:, None] + 10  # all on one side of the plane: one bucket
        return vectors_df(spark, [(shift + k, x, 0) for k, x in enumerate(v)])

    q, t = unit(1000, 0).cache(), unit(2000, 5000).cache()
    said, size = {}, {}
    for near in (False, True):
        pairs = similarity_join(q, t, ONE_BUCKET, near_first=near)
        pairs = pairs.select("q_id", "t_id", F.round("distance", 6).alias("distance"))
        pairs.write.parquet(out := str(tmp_path / str(near)))
        back = spark.read.parquet(out)
        said[near] = back.agg(F.count("*"), F.countDistinct("q_id", "t_id"),
                              F.sum(F.xxhash64("q_id", "t_id", "distance").cast("decimal(38,0)"))).first()
        size[near] = sum(p.stat().st_size for p in (tmp_path / str(near)).glob("*.parquet"))
    assert said[True] == said[False] and said[True][0] == said[True][1] == 2_000_000
    assert size[True] < 7 * 2_000_000 < 8 * 2_000_000 < size[False]


@pytest.mark.parametrize("rows, most", [(3000, 1024), (25_600, 1600), (10 ** 9, 2048)])
def test_blocks_of_joins_grow_to_a_bound(spark, monkeypatch, rows, most):
    """at 1,024 rows a side every row of a large bucket was copied eight times."""
    t = vectors_df(spark, [(k, [100.0 + k, 0.0], 0) for k in range(4)])
    seen = []

    def keep(q_exp, t_exp, block_rows, *args, run=search.lsh_blocks, **opts):
        seen.append(block_rows)
        return run(q_exp, t_exp, block_rows, *args, **opts)

    monkeypatch.setattr(search, "lsh_blocks", keep)
    monkeypatch.setattr(search, "partitions_for", lambda *a: 4)
    assert similarity_join(t, t, ONE_BUCKET, counts=(rows // 4, rows)).count() == 16
    assert seen == [most]


@pytest.mark.parametrize("name", ["similarity_join", "similarity_join_euclid", "similarity_join_default"])
def test_queries_that_write_pairs_put_near_ones_first(spark, monkeypatch, name):
    made = []

    def keep(*args, kind=search.BlockKernel, **opts):
        made.append(kind(*args, **opts))
        return made[-1]

    monkeypatch.setattr(search, "BlockKernel", keep)
    entry.queries()[name](spark, SF001)
    assert [(k.k, k.near_first) for k in made] == [(None, True)]


def test_distances_round_as_before(spark):
    """Halves of the last digit, their neighbours in float64, and values far from any distance."""
    halves = np.r_[np.arange(3000) * 1e-6 + 5e-7, 1.4 + np.arange(3000) * 1e-6 + 5e-7]
    values = np.r_[halves, np.nextafter(halves, 9), np.nextafter(halves, 0), np.sqrt(np.random.default_rng(1).random(5000)),
                   0.0, 5e-324, 4.9999999e-7, 123456.7890125, 1e9, 1e16, 1e300, -1.5, -2.0000005, np.inf, np.nan]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "distance double")
    odd = df.select(_r("distance").alias("a"), _r_pairs("distance").alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    assert odd.collect() == []
