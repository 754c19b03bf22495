"""Copies of rows grow with the table, and a task's memory is set by constants."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from annspark import EuclideanFamily, SignFamily, exact_knn, knn_join, similarity_join
from annspark.operators import blocks, pruned, search, sweeps
from annspark.operators.blocks import MAX_SPLITS, BlockKernel, block_size
from annspark.operators.late import LateSearch
from annspark.operators.pruned import PrunedSearch, Rings
from tests.conftest import vectors_df


def table(spark, n, seed, shift=0, width=4):
    rng = np.random.default_rng(seed)
    return vectors_df(spark, [(shift + k, rng.normal(size=width), k % 3) for k in range(n)])


@pytest.fixture(scope="module")
def sides(spark):
    return table(spark, 400, 1, 10_000).cache(), table(spark, 1200, 2).cache()


@pytest.fixture
def sent(monkeypatch):
    """Both sides and the keys of the blocks that searches and sweeps run."""
    got = []
    for module in (search, sweeps):
        def keep(q_side, t_side, keys, *args, run=module.run_blocks, **opts):
            got.append((q_side, t_side, keys))
            return run(q_side, t_side, keys, *args, **opts)
        monkeypatch.setattr(module, "run_blocks", keep)
    return got


def test_blocks_grow_once_a_table_is_cut_into_many():
    assert block_size(64, 900, 256) == 64
    assert block_size(64, 480_000, 256) == 480_000 // MAX_SPLITS
    assert block_size(64, 10 ** 9, 256) * 256 <= blocks.EXACT_BLOCK_BYTES
    assert block_size(4096, 10, 10 ** 9) == 4096


@pytest.mark.parametrize("family", [None, SignFamily(3, 1), SignFamily(2, 3)])
def test_copies_of_a_row_are_bounded(sides, sent, family):
    """with 4 rows a block every row was copied hundreds of times."""
    q, t = sides
    knn_join(q, t, family, 3, block_rows=4, max_broadcast_rows=0)
    (q_side, t_side, _), = sent
    tables = family.n_tables if family else 1
    assert q_side.count() <= 400 * tables * (MAX_SPLITS + 1)
    assert t_side.count() <= 1200 * tables * (MAX_SPLITS + 1)


def test_copies_of_sweeps_are_bounded(sides, sent):
    """F7, F8."""
    q, t = sides
    variants = [sweeps.Variant(lambda b: sweeps.euclid_buckets(b, 2.0), (1, 2))]
    family = EuclideanFamily(2.0, 2)
    sweeps.tagged_search(q, t, lambda col, w: sweeps.projection_column(family, w, col), variants, 3, block_rows=4)
    (q_side, t_side, _), = sent
    assert q_side.count() <= 400 * 2 * (MAX_SPLITS + 1) and t_side.count() <= 1200 * 2 * (MAX_SPLITS + 1)


def test_copies_of_the_late_search_are_bounded(sides):
    """F3."""
    q, t = sides
    late = LateSearch(q, t, SignFamily(3, 1), 3, block_rows=4)
    assert late.copies <= 1600 * 3 * (MAX_SPLITS + 1)


def test_blocks_of_joins_stay_small(spark, sent):
    """all pairs of a block are one result, so its pairs are bounded."""
    t = table(spark, 3000, 5).cache()
    similarity_join(t, t, SignFamily(1, 1), None)
    q_side, t_side, keys = sent[0]
    for side in (q_side, t_side):
        assert side.groupBy(*keys).count().agg({"count": "max"}).first()[0] <= 1.25 * 1024


def test_a_block_takes_little_memory_beside_its_rows():
    """4096 x 4096 pairs, of which a chunk is held at a time."""
    rng = np.random.default_rng(7)

    def rows(p, n):
        vec = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 8)), 8).cast(pa.list_(pa.float64()))
        return pa.table({f"{p}_id": pa.array(np.arange(n)), f"{p}_vec": vec,
                         **({"t_label": pa.array(np.zeros(n, dtype=np.int32))} if p == "t" else {})})

    q, t = rows("q", 4096), rows("t", 4096)
    tracemalloc.start()
    try:
        got = BlockKernel(5, None, False, first_table=False)(q, t)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.num_rows == 5 * 4096 and peak < 20e6


def test_a_bound_of_the_kth_distance():
    rng = np.random.default_rng(8)
    d2 = rng.random((40, 3000)).astype(np.float32)
    d2[3, 7:] = np.inf
    d2[4] = 0.5
    true, bound = np.sort(d2, axis=1)[:, 4], blocks._kth_bound(d2, 5)
    assert (bound >= true).all()
    finite = np.isfinite(bound)
    assert (d2[finite] <= bound[finite, None]).sum(axis=1)[:3].max() < 64
    assert np.isfinite(d2[~finite]).sum() <= 5 * blocks.FOLD


def test_rings_are_few_and_handed_on_in_parts(spark, sides):
    """a query went to thousands of rings, whose rows were one batch of gigabytes."""
    q, t = sides
    made = PrunedSearch(q, t, 3, n_pivots=4, block_rows=1)
    assert len(made.rings.n) <= pruned.MAX_RINGS + 4 and pruned.MAX_RINGS + pruned.MAX_PIVOTS <= 512
    got, want = (sorted(map(tuple, df.select("q_id", "rn", "t_id").collect()))
                 for df in (made.search(), exact_knn(q, t, 3)))
    assert got == want
    n = 200
    rings = Rings(np.zeros((1, 4)), np.zeros(n, int), np.arange(n), np.full(n, 5), np.zeros(n), np.full(n, 9.0))
    batch = pa.record_batch({
        "q_id": pa.array(np.arange(300)), "tau": pa.array(np.full(300, np.inf)),
        "q_vec": pa.array([[1.0] * 4] * 300), "cell": pa.array(np.zeros(300, np.int32)),
        "ring": pa.array(np.zeros(300, np.int32))})
    sizes = [b.num_rows for b in rings.others()([batch])]
    assert sum(sizes) == 300 * (n - 1) and max(sizes) <= pruned.BATCH_ROWS
