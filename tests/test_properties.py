"""Randomised properties against numpy brute force (hypothesis, few examples: each one
runs Spark jobs)."""

import os

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from annspark.functions.hashing import EuclideanFamily, SignFamily
from annspark.operators.search import knn_join, similarity_join
from tests.conftest import vectors_df
from tests.test_search import as_lists, brute, rows

SETTINGS = settings(max_examples=int(os.environ.get("PROPERTY_EXAMPLES", "6")), deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

cases = st.fixed_dictionaries({
    "seed": st.integers(0, 10_000),
    "n_q": st.integers(1, 25),
    "n_t": st.integers(1, 80),
    "width": st.integers(1, 9),
    "k": st.integers(1, 7),
    "copies": st.integers(0, 30),
    "block_rows": st.sampled_from([3, 16, 2048]),
    "family": st.sampled_from(["none", "sign", "euclid"]),
    "threshold": st.sampled_from([None, 1.0, 2.5]),
    "exclude_self": st.booleans(),
})


def _make(spark, c):
    rng = np.random.default_rng(c["seed"])
    tx = rng.standard_normal((c["n_t"], c["width"]))
    if c["copies"]:
        tx = np.vstack([tx, np.repeat(tx[:1], c["copies"], axis=0)])
    tid = rng.permutation(len(tx)).astype(np.int64)
    qx = np.vstack([rng.standard_normal((c["n_q"], c["width"])), tx[:1]])
    qid = np.arange(len(qx), dtype=np.int64) + (0 if c["exclude_self"] else 100_000)
    t = vectors_df(spark, [(tid[i], tx[i], i % 3) for i in range(len(tx))])
    q = vectors_df(spark, [(qid[i], qx[i], 0) for i in range(len(qx))])
    fam = {"none": None, "sign": SignFamily(3, 2, seed=c["seed"]),
           "euclid": EuclideanFamily(1.5, 2, seed=c["seed"])}[c["family"]]
    mask = None
    if fam is not None:
        mask = (fam.signatures(qx)[:, None, :] == fam.signatures(tx)[None, :, :]).any(-1)
    return q, t, qx, tx, qid, tid, fam, mask


@SETTINGS
@given(c=cases)
def test_knn_join_equals_brute_force(spark, c):
    q, t, qx, tx, qid, tid, fam, mask = _make(spark, c)
    want = brute(qx, tx, qid, tid, c["k"], exclude_self=c["exclude_self"], mask=mask,
                 threshold=c["threshold"])
    want = {key: v for key, v in want.items() if v}
    got = as_lists(knn_join(q, t, fam, c["k"], c["threshold"], c["exclude_self"],
                            block_rows=c["block_rows"]))
    assert got == want


@SETTINGS
@given(c=cases)
def test_similarity_join_equals_brute_force(spark, c):
    q, t, qx, tx, qid, tid, fam, mask = _make(spark, c)
    d = np.sqrt(((qx[:, None, :] - tx[None, :, :]) ** 2).sum(-1))
    ok = np.ones(d.shape, bool) if mask is None else mask.copy()
    if c["threshold"] is not None:
        ok &= d < c["threshold"]
    if c["exclude_self"]:
        ok &= qid[:, None] != tid[None, :]
    want = sorted((int(qid[a]), int(tid[b])) for a, b in zip(*np.nonzero(ok)))
    got = rows(similarity_join(q, t, fam, c["threshold"], c["exclude_self"],
                               block_rows=c["block_rows"]), "q_id", "t_id")
    assert got == want
