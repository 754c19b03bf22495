import numpy as np
import pytest
from pyspark.sql import functions as F

from annspark.functions.hashing import EuclideanFamily, SignFamily
from annspark.operators.blocks import count_rows, lsh_blocks
from annspark.operators.search import exact_knn, knn_join, knn_one, similarity_join
from tests.conftest import vectors_df


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def brute(q, t, qid, tid, k, exclude_self=False, mask=None, threshold=None):
    d = np.sqrt(((q[:, None, :] - t[None, :, :]) ** 2).sum(-1))
    out = {}
    for a in range(len(q)):
        ok = np.ones(len(t), bool)
        if mask is not None:
            ok &= mask[a]
        if exclude_self:
            ok &= tid != qid[a]
        if threshold is not None:
            ok &= d[a] < threshold
        idx = [j for j in np.lexsort((tid, d[a])) if ok[j]][:k]
        out[int(qid[a])] = [(int(tid[j]), round(float(d[a, j]), 9)) for j in idx]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("q_id", "rn").collect():
        out.setdefault(r["q_id"], []).append((r["t_id"], round(r["distance"], 9)))
    return out


def test_exact_top_k_tiny(tiny_2d):
    q, t = tiny_2d
    res = exact_knn(q, t, k=2)
    got = rows(res, "q_id", "t_id", "rn")
    assert got == [(10, 1, 1), (10, 2, 2), (11, 4, 1), (11, 5, 2)]
    dist = {(r["q_id"], r["t_id"]): r["distance"] for r in res.collect()}
    assert dist[(10, 1)] == pytest.approx(np.hypot(0.2, 0.1))
    assert {r["n_candidates"] for r in res.collect()} == {5}


def test_distance_ties_break_by_id(spark):
    t = vectors_df(spark, [(7, [1, 0], 0), (3, [-1, 0], 1), (5, [0, 1], 2), (9, [0, 3], 0)])
    q = vectors_df(spark, [(1, [0, 0], 0)])
    got = rows(exact_knn(q, t, k=3), "t_id", "rn")
    assert got == [(3, 1), (5, 2), (7, 3)]


def test_threshold_is_strict(tiny_2d):
    q, t = tiny_2d
    res = exact_knn(q, t, k=5, threshold=1.0)
    # [5,5] to [5,5.4] is 0.4; [5,6] is 0.6; [0,0] to [0.2,0.1] ~0.22, [1,0] ~0.81, [0,1] ~0.92
    assert rows(res, "q_id", "t_id") == [(10, 1), (10, 2), (10, 3), (11, 4), (11, 5)]
    zero = exact_knn(q.where("id = 11").withColumn("features", F.array(F.lit(5.0), F.lit(5.0))),
                     t, k=5, threshold=0.0)
    assert zero.count() == 0  # distance 0 is not < 0


def test_self_search_excludes_only_self(tiny_2d):
    _, t = tiny_2d
    res = exact_knn(t, t, k=1, exclude_self=True)
    got = dict(rows(res, "q_id", "t_id"))
    assert got == {1: 2, 2: 1, 3: 1, 4: 5, 5: 4}


def test_equal_vectors_kept_apart(spark, tiny_2d):
    _, t = tiny_2d
    q = vectors_df(spark, [(20, [0, 0], 0), (21, [0, 0], 1)])
    res = exact_knn(q, t, k=1)
    assert rows(res, "q_id", "t_id") == [(20, 1), (21, 1)]


def _random(spark, n, d, seed, start=0, centres=None):
    rng = np.random.default_rng(seed)
    if centres is None:
        x = rng.standard_normal((n, d))
    else:
        x = centres[rng.integers(0, len(centres), n)] + 0.05 * rng.standard_normal((n, d))
    ids = np.arange(start, start + n)
    return vectors_df(spark, [(ids[i], x[i], i % 3) for i in range(n)]), x, ids


def test_lsh_matches_brute_force_and_blocks_do_not_matter(spark):
    q, qx, qid = _random(spark, 30, 6, 1, start=1000)
    t, tx, tid = _random(spark, 120, 6, 2)
    fam = SignFamily(4, 3, seed=5)
    sq, st = fam.signatures(qx), fam.signatures(tx)
    mask = (sq[:, None, :] == st[None, :, :]).any(-1)
    want = brute(qx, tx, qid, tid, 4, mask=mask)
    want = {k: v for k, v in want.items() if v}
    for block_rows in (4, 10_000):
        got = as_lists(knn_join(q, t, fam, k=4, block_rows=block_rows))
        assert got == want
    counts = {r["q_id"]: r["n_candidates"]
              for r in knn_join(q, t, fam, k=4, block_rows=4).collect()}
    for a, i in enumerate(qid):
        if mask[a].any():
            assert counts[int(i)] == mask[a].sum()


def test_hot_bucket_is_split_and_result_unchanged(spark):
    """90 % of rows in one cluster: the hot bucket is cut into blocks, same answer."""
    rng = np.random.default_rng(3)
    hot = np.array([[4.0, 4.0, 4.0, 4.0]])
    tx = np.vstack([hot + 0.01 * rng.standard_normal((180, 4)), rng.standard_normal((20, 4))])
    qx = np.vstack([hot + 0.01 * rng.standard_normal((45, 4)), rng.standard_normal((5, 4))])
    tid, qid = np.arange(200), np.arange(1000, 1050)
    t = vectors_df(spark, [(tid[i], tx[i], i % 2) for i in range(200)])
    q = vectors_df(spark, [(qid[i], qx[i], 0) for i in range(50)])
    fam = SignFamily(2, 2, seed=1)
    # The split itself: the hot bucket gets several training and query blocks.
    from annspark.operators.search import _sides
    from annspark.functions.hashing import signature_column
    qs, ts = _sides(q, t, "id", "features", "label")
    qs = qs.withColumn("q_sig", signature_column(fam, 4, "q_vec"))
    ts = ts.withColumn("t_sig", signature_column(fam, 4, "t_vec"))
    q_exp = qs.select("*", F.posexplode_outer("q_sig").alias("tbl", "bucket"))
    t_exp = ts.select("*", F.posexplode_outer("t_sig").alias("tbl", "bucket"))
    n_q, n_t = count_rows(qs, ts)
    q_side, t_side, added = lsh_blocks(q_exp, t_exp, 16, 1000, n_q, n_t)
    assert added > 0  # the copies count towards the partitions
    assert t_side.agg(F.max("tblock")).first()[0] >= 5
    assert q_side.agg(F.max("qblock")).first()[0] >= 1
    sq, st = fam.signatures(qx), fam.signatures(tx)
    mask = (sq[:, None, :] == st[None, :, :]).any(-1)
    want = {k: v for k, v in brute(qx, tx, qid, tid, 5, mask=mask).items() if v}
    assert as_lists(knn_join(q, t, fam, k=5, block_rows=16)) == want
    # The same with the hot list forced through the shuffle-join path.
    assert as_lists(knn_join(q, t, fam, k=5, block_rows=16, max_broadcast_rows=0)) == want


def test_exact_blocks_grid(spark):
    q, qx, qid = _random(spark, 40, 5, 4, start=500)
    t, tx, tid = _random(spark, 90, 5, 5)
    want = brute(qx, tx, qid, tid, 3)
    assert as_lists(exact_knn(q, t, 3, block_rows=7)) == want
    assert as_lists(exact_knn(q, t, 3)) == want


def test_copies_tie_at_the_cut(spark):
    """A third of the training rows are copies of one vector: ties broken by id."""
    rng = np.random.default_rng(8)
    tx = np.vstack([np.tile([[1.0, 1.0, 1.0]], (40, 1)), rng.standard_normal((80, 3)) * 5])
    tid = np.arange(120)[::-1].copy()
    t = vectors_df(spark, [(tid[i], tx[i], 0) for i in range(120)])
    q = vectors_df(spark, [(900, [1.0, 1.0, 1.1], 0)])
    got = as_lists(exact_knn(q, t, 5, block_rows=16))[900]
    assert [g[0] for g in got] == sorted(tid[:40])[:5]


def test_lsh_pairs_subset_of_exact_and_tables_monotone(spark):
    q, qx, qid = _random(spark, 25, 8, 6, start=300)
    t, tx, tid = _random(spark, 80, 8, 7)
    exact = set(rows(similarity_join(q, t, None, 4.0), "q_id", "t_id"))
    few = set(rows(similarity_join(q, t, SignFamily(2, 3, seed=9), 4.0), "q_id", "t_id"))
    more = set(rows(similarity_join(q, t, SignFamily(4, 3, seed=9), 4.0), "q_id", "t_id"))
    assert few <= more <= exact
    # More bits draw the same first planes plus new ones: buckets only get finer.
    bits = set(rows(similarity_join(q, t, SignFamily(4, 5, seed=9), 4.0), "q_id", "t_id"))
    assert bits <= more


def test_similarity_join_each_pair_once(spark):
    q, qx, qid = _random(spark, 20, 4, 10, start=100)
    t, tx, tid = _random(spark, 60, 4, 11)
    res = similarity_join(q, t, EuclideanFamily(3.0, 4, seed=2), None)
    pairs = rows(res, "q_id", "t_id")
    assert len(pairs) == len(set(pairs))
    fam = EuclideanFamily(3.0, 4, seed=2)
    mask = (fam.signatures(qx)[:, None, :] == fam.signatures(tx)[None, :, :]).any(-1)
    assert len(pairs) == mask.sum()


def test_result_independent_of_partitioning(spark):
    q, _, _ = _random(spark, 30, 6, 12, start=700)
    t, _, _ = _random(spark, 100, 6, 13)
    fam = SignFamily(3, 3, seed=3)
    a = as_lists(knn_join(q.repartition(1), t.repartition(1), fam, 3))
    b = as_lists(knn_join(q.repartition(7), t.repartition(5), fam, 3))
    assert a == b


def test_knn_one_matches_brute_force(spark):
    t, tx, tid = _random(spark, 150, 6, 14)
    key = np.random.default_rng(15).standard_normal(6)
    res = knn_one(t, key, None, k=4).orderBy("rn").collect()
    d = np.sqrt(((tx - key) ** 2).sum(1))
    want = [int(tid[j]) for j in np.lexsort((tid, d))[:4]]
    assert [r["id"] for r in res] == want
    assert [r["rn"] for r in res] == [1, 2, 3, 4]
    fam = SignFamily(3, 4, seed=1)
    mask = (fam.signatures(key[None, :]) == fam.signatures(tx)).any(1)
    dl = np.where(mask, d, np.inf)
    want = [int(tid[j]) for j in np.lexsort((tid, dl)) if np.isfinite(dl[j])][:4]
    assert [r["id"] for r in knn_one(t, key, fam, k=4).orderBy("rn").collect()] == want


def test_bl_large_leaves_few_buckets(spark):
    t, tx, _ = _random(spark, 100, 4, 16)
    from annspark.operators.index import bucket_summary
    fam = EuclideanFamily(1e6, 3, seed=1)
    per_table = bucket_summary(t, fam, 4).groupBy("tbl").count().collect()
    assert all(r["count"] <= 2 for r in per_table)


def test_index_reuse_matches_direct(spark):
    from annspark.operators.index import build_index

    q, qx, qid = _random(spark, 30, 6, 21, start=5000)
    t, tx, tid = _random(spark, 150, 6, 22)
    fam = SignFamily(4, 3, seed=7)
    index = build_index(t, fam)
    assert set(index.columns) == {"id", "features", "label", "sig"}
    assert as_lists(knn_join(q, index, fam, 4, train_sig="sig", block_rows=8)) == \
        as_lists(knn_join(q, t, fam, 4))
    key = qx[0]
    a = [r["id"] for r in knn_one(index, key, fam, 4, train_sig="sig").orderBy("rn").collect()]
    b = [r["id"] for r in knn_one(t, key, fam, 4).orderBy("rn").collect()]
    assert a == b


def test_wide_band_of_copies_matches_brute_force(spark):
    """Hundreds of copies of a few vectors: the deduplicating path, same answers."""
    rng = np.random.default_rng(31)
    copies = np.repeat(rng.standard_normal((3, 5)), 150, axis=0)
    tx = np.vstack([copies, rng.standard_normal((100, 5))])
    tid = rng.permutation(np.arange(10_000, 10_000 + len(tx)))
    qx = np.vstack([copies[[0, 150, 300]], copies[[0, 150]] + 0.01, rng.standard_normal((10, 5))])
    qid = np.arange(len(qx))
    t = vectors_df(spark, [(tid[i], tx[i], i % 3) for i in range(len(tx))])
    q = vectors_df(spark, [(qid[i], qx[i], 0) for i in range(len(qx))])
    want = brute(qx, tx, qid, tid, 6)
    assert as_lists(exact_knn(q, t, 6)) == want
    assert as_lists(exact_knn(q, t, 6, block_rows=64)) == want
    fam = SignFamily(3, 2, seed=5)
    mask = (fam.signatures(qx)[:, None, :] == fam.signatures(tx)[None, :, :]).any(-1)
    want = {k: v for k, v in brute(qx, tx, qid, tid, 6, mask=mask).items() if v}
    assert as_lists(knn_join(q, t, fam, 6, block_rows=64)) == want


def test_bucket_index_lookup_matches_and_prunes(spark):
    from annspark.operators.index import build_bucket_index
    from annspark.operators.search import knn_one_indexed

    t, tx, tid = _random(spark, 200, 6, 41)
    fam = SignFamily(4, 3, seed=9)
    path = build_bucket_index(t, fam)
    for seed in range(3):
        key = np.random.default_rng(100 + seed).standard_normal(6)
        a = [(r["id"], round(r["distance"], 9)) for r in knn_one_indexed(spark, path, key, fam, 5).orderBy("rn").collect()]
        b = [(r["id"], round(r["distance"], 9)) for r in knn_one(t, key, fam, 5).orderBy("rn").collect()]
        assert a == b
    plan = knn_one_indexed(spark, path, key, fam, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tbl" in plan and "EqualTo(bucket" in plan
