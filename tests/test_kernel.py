"""The block kernel on hand-built Arrow tables (no Spark): every path against numpy."""

import numpy as np
import pyarrow as pa
import pytest

from annspark.operators.blocks import SPARSE_ROWS, WIDE_BAND, BlockKernel


def _lists(x, dtype):
    n, w = x.shape
    offsets = np.arange(n + 1, dtype=np.int32) * w
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel().astype(dtype)))


def _tables(qx, tx, qsig, tsig, tbl, qid, tid):
    q = pa.table({"q_id": pa.array(qid), "q_vec": _lists(qx, np.float32),
                  "q_sig": _lists(qsig[:, :tbl], np.int64), "tbl": pa.array(np.full(len(qx), tbl, np.int32))})
    t = pa.table({"t_id": pa.array(tid), "t_vec": _lists(tx, np.float32),
                  "t_sig": _lists(tsig[:, :tbl], np.int64), "t_label": pa.array(np.zeros(len(tx))),
                  "tbl": pa.array(np.full(len(tx), tbl, np.int32))})
    return q, t


def _brute(qx, tx, qid, tid, live, k, threshold):
    qx, tx = qx.astype(np.float32).astype(np.float64), tx.astype(np.float32).astype(np.float64)
    d = np.sqrt(((qx[:, None, :] - tx[None, :, :]) ** 2).sum(-1))
    ok = live.copy()
    if threshold is not None:
        ok &= d < threshold
    out = {}
    for a in range(len(qx)):
        idx = [b for b in np.lexsort((tid, d[a])) if ok[a, b]]
        out[int(qid[a])] = ([(int(tid[b]), float(d[a, b])) for b in idx[:k]] if k else
                            sorted((int(tid[b]), float(d[a, b])) for b in idx), int(ok[a].sum()))
    return out


def _run(kernel, q, t):
    res = kernel(q, t).to_pydict()
    got = {}
    for qi, ti, dist, n in zip(res["q_id"], res["t_id"], res["distance"], res["n_cand"]):
        pairs, cnt = got.get(qi, ([], 0))
        got[qi] = (pairs + [(ti, dist)], cnt + n)
    return got


@pytest.mark.parametrize("threshold", [None, 9.0])
@pytest.mark.parametrize("k", [3, None])
def test_mostly_blocked_rows_use_pairs_and_match(k, threshold):
    rng = np.random.default_rng(0)
    nq, nt = 40, 400
    qx, tx = rng.standard_normal((nq, 6)), rng.standard_normal((nt, 6))
    qid, tid = np.arange(nq), np.arange(1000, 1000 + nt)
    # Table 0 bucket shared by almost every pair: at table 1 most pairs are blocked.
    qsig = np.zeros((nq, 2), np.int64)
    tsig = np.zeros((nt, 2), np.int64)
    tsig[:10, 0] = 1  # only these 10 training rows are live for every query
    q, t = _tables(qx, tx, qsig, tsig, 1, qid, tid)
    live = np.broadcast_to(tsig[:, 0] != qsig[0, 0], (nq, nt))
    assert (live.sum(1) * SPARSE_ROWS <= nt).all()  # the pair-by-pair path
    kernel = BlockKernel(k, threshold, exclude_self=False, first_table=True)
    got = _run(kernel, q, t)
    want = _brute(qx, tx, qid, tid, live, k, threshold)
    assert set(got) <= set(want)
    for qi, (pairs, cnt) in want.items():
        if not pairs:
            assert qi not in got
            continue
        gp, gc = got[qi]
        assert [p[0] for p in (gp if k else sorted(gp))] == [p[0] for p in pairs]
        np.testing.assert_allclose([p[1] for p in (gp if k else sorted(gp))], [p[1] for p in pairs])
        if k:
            assert gc == cnt


def test_wide_band_copies_break_ties_by_id():
    nq, nt = 20, 300
    v = np.zeros((1, 4)); v[0, 0] = 1
    tx = np.vstack([np.repeat(v, 250, axis=0), np.random.default_rng(1).standard_normal((50, 4))])
    tid = np.random.default_rng(2).permutation(nt).astype(np.int64) + 7
    qx = np.repeat(v, nq, axis=0)
    sig = np.zeros((nq, 1), np.int64)
    q, t = _tables(qx, tx, sig, np.zeros((nt, 1), np.int64), 0, np.arange(nq), tid)
    kernel = BlockKernel(4, None, exclude_self=False, first_table=False)
    assert 250 * nq > WIDE_BAND * 4 * nq  # the deduplicating path
    got = _run(kernel, q, t)
    lowest = sorted(tid[:250])[:4]
    for pairs, cnt in got.values():
        assert [p[0] for p in pairs] == lowest and all(p[1] == 0.0 for p in pairs)
        assert cnt == nt
