"""Bounded blocks for pairwise work, and the per-block distance kernel.

All candidate work (LSH buckets and exact search) runs as a cogroup of query rows and
training rows on a block key. A block holds at most about ``block_rows`` rows of each
side, whatever the data: a bucket (or the whole table, for exact search) with more rows
is cut into ``ceil(n / block_rows)`` blocks by a hash of the row id, and the other side
of that bucket is replicated to every block. So a hot bucket that holds a third of all
rows turns into many bounded tasks instead of one huge one, and no pair is ever emitted
as a row: the kernel keeps only the top k per query (or the pairs within a threshold,
which are the result of a similarity join).

Cutting copies rows: each row of one side goes to every block of the other. So that copies
grow with the table and not with its square, top-k searches let blocks grow once a table
would be cut into more than ``MAX_SPLITS`` of them (``block_size``), up to the bytes a task
may hold of a side; the kernel's own memory is set by its chunks, not by the block.

Each (query, training) pair meets in exactly one block per table they share; a pair that
shares several tables is only counted at the first one (signature comparison), so no
later ``distinct`` shuffle is needed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annspark.functions.hashing import arrow_matrix
from annspark.functions.sparse import block_matrices

DEFAULT_BLOCK_ROWS = 2048
DEFAULT_MAX_BROADCAST_ROWS = 100_000
# Vector bytes of a side of an exact block: the copies of each side fall with the other
# side's block size, and the kernel works through a block in chunks anyway.
EXACT_BLOCK_BYTES = 8 * 1024 * 1024
# Blocks a table is cut into before blocks grow instead.
MAX_SPLITS = 16
# Rows a side of a block whose pairs are all returned (joins), and the most it grows to: the
# block's result is one table.
JOIN_BLOCK_ROWS = 1024
JOIN_MOST_ROWS = 2048
# Pairs of a join that are handed on at once.
PAIR_ROWS = 131_072
# Pairs of a block from which putting near ones first saves bytes: fewer hardly share a rounded
# distance, and ids take more in that order.
NEAR_FIRST_PAIRS = 500_000
# Values of a chunk's distance matrix.
CHUNK_VALUES = 1_000_000
# Values of the vectors gathered at a time for exact distances: they stay in the CPU's cache.
EXACT_VALUES = 65_536
# Columns of a chunk of which only the least distance is looked at to find a bound of the k-th.
FOLD = 32
# Target bytes per cogroup partition, used to scale the partition count with the data
# (rows, replication and vector width) instead of trusting a fixed shuffle setting.
PARTITION_BYTES = 256 * 1024 * 1024
# Bytes of a shuffled row besides its vector: ids, label, keys, earlier buckets.
ROW_OVERHEAD = 64
# A block whose candidate band exceeds this many times k per query takes the
# deduplicating path (copies of vectors make every copy a candidate).
WIDE_BAND = 8
# A row whose live (unblocked) pairs are at most 1/SPARSE_ROWS of the block is scored
# pair by pair instead of through the matrix product.
SPARSE_ROWS = 16
# Small buckets of one table share a cogroup group of about this many rows (pairs from
# different buckets are blocked in the kernel), so tiny buckets do not each pay a
# Python call.
MERGE_ROWS = 512

KERNEL_SCHEMA = "q_id long, t_id long, t_label {label}, distance double, n_cand long"


def collect_if_small(df: DataFrame, max_rows: int) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``max_rows`` rows, else None.

    The check reads at most ``max_rows + 1`` rows, so what comes back to the driver is
    bounded by the argument, never by the data. Callers broadcast the result and fall
    back to a shuffle join on None.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


DEFAULT_SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str, spread_col: str,
                salts: int = DEFAULT_SALTS) -> DataFrame:
    """Shuffle join for a ``big`` side that is skewed on ``on`` (hot buckets).

    ``small`` has few rows per key: each is replicated to ``salts`` salt values, and each
    ``big`` row takes the salt ``xxhash64(spread_col) mod salts``, so one hot key is
    spread over ``salts`` tasks instead of one. Same rows as the plain join.
    """
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(spread_col), F.lit(salts)).cast("int"))
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")


def join_checked(big: DataFrame, small: DataFrame, on, how: str,
                 max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                 spread_col: str | None = None) -> DataFrame:
    """Join with ``small`` broadcast if its size is proven small, else a shuffle join
    (salted by ``spread_col`` when given, for a ``big`` side skewed on the keys)."""
    local = collect_if_small(small, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    if spread_col is not None:
        return salted_join(big, small, list(on), how, spread_col)
    return big.join(small, on, how)


def _replicate(df: DataFrame, own_block: str, own_count: str, id_col: str,
               other_block: str, other_count: str) -> DataFrame:
    return (df
            .withColumn(own_block, F.pmod(F.xxhash64(id_col), F.col(own_count)).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
            .drop(own_count, other_count))


def block_size(block_rows: int, n_rows: int, row_bytes: float) -> int:
    """Rows a side of a block: ``block_rows``, and more where a table of ``n_rows`` would be cut
    into over ``MAX_SPLITS`` blocks, up to ``EXACT_BLOCK_BYTES`` of vectors."""
    most = int(EXACT_BLOCK_BYTES // max(1, row_bytes))
    return max(block_rows, min(most, math.ceil(n_rows / MAX_SPLITS)))


def count_rows(q_rows: DataFrame, t_rows: DataFrame) -> tuple[int, int]:
    """Row counts of both sides in one job; only ids are read (no vectors, no hashing)."""
    both = (q_rows.select(F.lit(1).alias("_q"), F.lit(0).alias("_t"))
            .unionByName(t_rows.select(F.lit(0).alias("_q"), F.lit(1).alias("_t"))))
    row = both.agg(F.sum("_q").alias("q"), F.sum("_t").alias("t")).first()
    return int(row["q"] or 0), int(row["t"] or 0)


def uniform_blocks(q_exp: DataFrame, t_exp: DataFrame, n_tb: int, n_qb: int):
    t_side = _replicate(t_exp.withColumn("n_tb", F.lit(n_tb)).withColumn("n_qb", F.lit(n_qb)),
                        "tblock", "n_tb", "t_id", "qblock", "n_qb")
    q_side = _replicate(q_exp.withColumn("n_tb", F.lit(n_tb)).withColumn("n_qb", F.lit(n_qb)),
                        "qblock", "n_qb", "q_id", "tblock", "n_tb")
    return q_side, t_side


def with_queries_only(t_exp: DataFrame, q_exp: DataFrame, n_tables: int,
                      max_broadcast_rows: int, table: tuple[str, ...] = ("tbl",)) -> DataFrame:
    """Training rows whose bucket some query may have; the others are not shuffled.

    Buckets are hashed to ``max_broadcast_rows / n_tables`` slots a table, so the list of
    the queries' slots has at most ``max_broadcast_rows`` rows whatever the data and can
    always be broadcast. A slot shared by chance keeps a row that the kernel then finds
    without partners; no row with a partner is dropped.
    """
    slots = max(1, max_broadcast_rows // max(1, n_tables))
    slot = F.pmod(F.xxhash64(*table, "bucket"), F.lit(slots)).alias("_slot")
    asked = q_exp.select(*table, slot).distinct()
    return t_exp.select("*", slot).join(F.broadcast(asked), [*table, "_slot"], "left_semi").drop("_slot")


def lsh_blocks(q_exp: DataFrame, t_exp: DataFrame, block_rows: int,
               max_broadcast_rows: int, n_q: int, n_t: int,
               table: tuple[str, ...] = ("tbl",)) -> tuple[DataFrame, DataFrame, int]:
    """Give exploded rows (``tbl, bucket`` per row) ``tblock, qblock`` keys; the third
    value counts the rows that splitting hot buckets adds. ``table`` names the columns
    that make a table.

    Bucket sizes come from one aggregation with map-side combine. Only buckets with more
    than ``block_rows`` rows on a side (and rows on both sides) are split; their list is
    broadcast only when it is proven small, else joined by a shuffle.
    """
    keys = [*table, "bucket"]
    # Buckets of a table are spread over about (rows per table) / MERGE_ROWS groups.
    n_groups = max(1, math.ceil((n_q + n_t) / min(MERGE_ROWS, block_rows)))
    q_exp = q_exp.withColumn("bgroup", F.pmod(F.xxhash64("bucket"), F.lit(n_groups)).cast("int"))
    t_exp = t_exp.withColumn("bgroup", F.pmod(F.xxhash64("bucket"), F.lit(n_groups)).cast("int"))
    if max(n_t, n_q) <= block_rows:
        # No bucket can hold more rows than its whole table: nothing to split, so the
        # sizing pass is skipped.
        return *uniform_blocks(q_exp, t_exp, 1, 1), 0
    sizes = (t_exp.select(*keys, F.lit(1).alias("n_t"), F.lit(0).alias("n_q"))
             .unionByName(q_exp.select(*keys, F.lit(0).alias("n_t"), F.lit(1).alias("n_q")))
             .groupBy(*keys)
             .agg(F.sum("n_t").alias("n_t"), F.sum("n_q").alias("n_q")))
    hot = (sizes
           .where(((F.col("n_t") > block_rows) | (F.col("n_q") > block_rows))
                  & (F.col("n_t") > 0) & (F.col("n_q") > 0))
           .select(*keys,
                   F.ceil(F.col("n_t") / block_rows).cast("int").alias("n_tb"),
                   F.ceil(F.col("n_q") / block_rows).cast("int").alias("n_qb"),
                   "n_t", "n_q"))
    local = collect_if_small(hot, max_broadcast_rows)
    copies = F.col("n_t") * (F.col("n_qb") - 1) + F.col("n_q") * (F.col("n_tb") - 1)
    added = int((local if local is not None else hot).agg(F.sum(copies)).first()[0] or 0)
    hot = hot.drop("n_t", "n_q")
    local = None if local is None else local.drop("n_t", "n_q")

    def attach(df, id_col):
        if local is not None:
            joined = df.join(F.broadcast(local), keys, "left")
        else:
            # Too many hot buckets to broadcast: the rows of a hot bucket are exactly the
            # skewed keys of this join, so it is salted.
            joined = salted_join(df, hot, keys, "left", id_col)
        return joined.fillna(1, subset=["n_tb", "n_qb"])

    t_side = _replicate(attach(t_exp, "t_id"), "tblock", "n_tb", "t_id", "qblock", "n_qb")
    q_side = _replicate(attach(q_exp, "q_id"), "qblock", "n_qb", "q_id", "tblock", "n_tb")
    return q_side, t_side, added


def exact_grid(block_rows: int, min_groups: int, n_q: int, n_t: int) -> tuple[int, int]:
    """Training and query blocks of an exact search: at most ``block_rows`` rows a side."""
    n_tb = max(1, math.ceil(n_t / block_rows))
    n_qb = max(1, math.ceil(n_q / block_rows))
    if n_tb * n_qb < min_groups:
        # Small inputs: split the training side further so all cores get work.
        n_tb = max(n_tb, min(math.ceil(min_groups / n_qb), max(1, n_t // 64)))
    return n_tb, n_qb


class BlockKernel:
    """Distances of one block of queries against one block of training rows.

    ``k`` given: the k nearest valid rows per query (order: distance, then t_id), plus
    the query's count of valid rows in this block on its first emitted row.
    ``k`` None: every valid pair (similarity join), with ``near_first`` near pairs first in
    blocks of many.
    Valid: within ``threshold`` (strict), not the query itself when ``exclude_self``,
    and, with ``first_table``, this is the first table where the two share a bucket.
    Ranking uses ||q||^2 + ||t||^2 - 2 q.t from one float32 matrix product (half the
    memory traffic of float64); the candidate margin covers the float32 rounding error
    (a bound in the width and the norms), and every emitted distance, and every
    comparison close to a cut, is recomputed exactly in float64 from the differences.
    """

    def __init__(self, k: int | None, threshold: float | None, exclude_self: bool,
                 first_table: bool, chunk_values: int = CHUNK_VALUES, near_first: bool = False):
        if threshold is not None and not threshold >= 0:
            raise ValueError("threshold must be a number not below 0")
        self.k = k
        self.threshold = threshold
        self.exclude_self = exclude_self
        self.first_table = first_table
        self.chunk_values = chunk_values
        self.near_first = near_first

    def __call__(self, q: pa.Table, t: pa.Table) -> pa.Table:
        if q.num_rows == 0 or t.num_rows == 0:
            none = np.zeros(0, dtype=np.int64)
            return _table(none, none, t.column("t_label").combine_chunks().slice(0, 0), none, none)
        return pa.concat_tables(self._parts(q, t.sort_by("t_id")))

    def _parts(self, q: pa.Table, t: pa.Table) -> list[pa.Table]:
        if pa.types.is_struct(q.schema.field("q_vec").type):
            dense = block_matrices(q.column("q_vec"), t.column("t_vec"))
            if dense is None:
                # Too many columns occur in these rows: the longer side is halved. A query
                # may then have rows and counts from both halves, as from two blocks.
                n = max(q.num_rows, t.num_rows) // 2
                halves = ([(q.slice(0, n), t), (q.slice(n), t)] if q.num_rows >= t.num_rows
                          else [(q, t.slice(0, n)), (q, t.slice(n))])
                return [part for half in halves for part in self._parts(*half)]
            return self._dense_parts(q, t, *dense)
        qv = arrow_matrix(q.column("q_vec"), dtype=None)
        return self._dense_parts(q, t, qv, arrow_matrix(t.column("t_vec"), qv.shape[1], dtype=None))

    def _dense_parts(self, q: pa.Table, t: pa.Table, qv: np.ndarray, tv: np.ndarray) -> list[pa.Table]:
        qid = q.column("q_id").to_numpy()
        tid = t.column("t_id").to_numpy()
        tlab = t.column("t_label").combine_chunks()  # Arrow: null labels stay null
        tbl = int(q.column("tbl")[0].as_py()) if self.first_table else 0
        qb = tb = None
        if "bucket" in q.column_names:
            qb = q.column("bucket").to_numpy()
            tb = t.column("bucket").to_numpy()
            if len(np.unique(qb)) == 1 and (tb == qb[0]).all():
                qb = tb = None  # one bucket: nothing to separate
        qsig = None
        earlier = []
        if tbl > 0:
            qsig, earlier = _earlier(arrow_matrix(q.column("q_sig"), dtype=np.int64)[:, :tbl],
                                     arrow_matrix(t.column("t_sig"), dtype=np.int64)[:, :tbl])
        # Ranking works on values scaled by one power of two per block (largest component
        # below 1), so squares neither overflow nor vanish in float32 at any magnitude.
        exp = int(np.frexp(max(np.abs(qv).max(initial=0.0), np.abs(tv).max(initial=0.0)))[1])
        q32 = np.ldexp(qv, -exp).astype(np.float32, copy=False)
        t32 = np.ldexp(tv, -exp).astype(np.float32, copy=False)
        qn = np.einsum("ij,ij->i", q32, q32)
        tn = np.einsum("ij,ij->i", t32, t32)
        # Rounding bound of the float32 expansion (inputs rounded to float32 included).
        err = 4.0 * (qv.shape[1] + 8) * float(np.finfo(np.float32).eps)
        tn_max = float(tn.max()) if len(tn) else 0.0
        step = max(1, self.chunk_values // max(1, len(tv)))
        parts = []
        for s in range(0, len(qv), step):
            e = min(len(qv), s + step)
            tol = err * (qn[s:e].astype(np.float64) + tn_max) + 1e-30
            i, j, dist, counts = self._chunk(qv[s:e], q32[s:e], qid[s:e], qn[s:e], tol, tv, t32, tid, tn,
                                             exp, None if qsig is None else qsig[s:e], earlier,
                                             None if qb is None else qb[s:e], tb)
            if self.k is None:
                parts.append(((i + s).astype(np.int32), j.astype(np.int32), dist))
            else:
                parts.append(self._nearest(i, j, dist, counts, qid[s:e], tid, tlab))
        return parts if self.k is not None else self._pairs(parts, qid, tid, tlab)

    def _chunk(self, qv, q32, qid, qn, tol, tv, t32, tid, tn, exp, qsig, earlier, qb=None, tb=None):
        """``(i, j, exact distance)`` of the pairs of a chunk of queries, for top k of a band
        that holds the k nearest, and each query's count of valid rows."""
        nq, nt = len(qv), len(tv)
        blocked = self._blocked(qid, tid, qsig, earlier, nq, nt)
        if qb is not None:  # several buckets share this group: only same-bucket pairs
            other = qb[:, None] != tb[None, :]
            blocked = other if blocked is None else np.logical_or(blocked, other, out=blocked)
        sparse = np.zeros(nq, dtype=bool)
        if blocked is not None:
            # Rows with few live pairs (most of their pairs were counted at an earlier
            # table: a hot bucket shared by every table) skip the matrix product.
            sparse = (nt - np.count_nonzero(blocked, axis=1)) * SPARSE_ROWS <= nt
        counts = np.zeros(nq, dtype=np.int64)
        parts = []
        rows = np.nonzero(sparse)[0]
        if len(rows):
            si, sj = np.divmod(np.flatnonzero(~blocked[rows]), nt)
            si = rows[si]
            sd = _exact(qv, tv, si, sj)
            if self.threshold is not None:
                keep = sd < self.threshold
                si, sj, sd = si[keep], sj[keep], sd[keep]
            counts += np.bincount(si, minlength=nq)
            parts.append((si, sj, sd))
        rows = np.nonzero(~sparse)[0]
        if len(rows):
            at = slice(None) if len(rows) == nq else rows  # all rows: nothing is copied
            di, dj, dd, dcounts = self._dense(qv[at], q32[at], qn[at], tol[at], tv, t32, tn,
                                              exp, None if blocked is None else blocked[at])
            counts[rows] = dcounts
            parts.append((rows[di], dj, dd))
        i = np.concatenate([p[0] for p in parts]).astype(np.int64)
        j = np.concatenate([p[1] for p in parts]).astype(np.int64)
        dist = np.concatenate([p[2] for p in parts]).astype(np.float64)
        return i, j, dist, counts

    def _nearest(self, i, j, dist, counts, qid, tid, tlab) -> pa.Table:
        # Final order per query: distance, then t_id; keep k, count on the first row.
        order = np.lexsort((tid[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, dtype=bool)
        first_pos = np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else start
        keep = (np.arange(len(i)) - first_pos) < self.k
        i, j, dist, start = i[keep], j[keep], dist[keep], start[keep]
        n = np.where(start, counts[i], 0).astype(np.int64)
        return _table(qid[i], tid[j], tlab.take(j), dist, n)

    def _pairs(self, parts, qid, tid, tlab) -> list[pa.Table]:
        """Pairs ``(i, j, distance)`` of a block as tables. Distances are most of a join's bytes,
        and hardly two in a row are alike in the order of queries; nearest first, those that
        round to the same value stand side by side, which files compress."""
        i, j, dist = (np.concatenate(column) for column in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(dist) if self.near_first and len(dist) >= NEAR_FIRST_PAIRS else None
        tables = []
        for s in range(0, max(1, len(dist)), PAIR_ROWS):
            at = slice(s, s + PAIR_ROWS) if order is None else order[s:s + PAIR_ROWS]
            tables.append(_table(qid[i[at]], tid[j[at]], tlab.take(pa.array(j[at])), dist[at],
                                 np.zeros(len(i[at]), dtype=np.int64)))
        return tables

    def _blocked(self, qid, tid, qsig, earlier, nq, nt):
        """Pairs that must not be scored here: the query itself (``exclude_self``) and
        pairs that share an earlier table (counted there). None when there are none."""
        blocked = None
        if self.exclude_self:  # training ids are sorted: one binary search per query
            pos = np.minimum(np.searchsorted(tid, qid), nt - 1)
            hit = tid[pos] == qid
            if hit.any():
                blocked = np.zeros((nq, nt), dtype=bool)
                blocked[np.nonzero(hit)[0], pos[hit]] = True
        for (order, vals, col), asked in zip(earlier, qsig.T if earlier else ()):
            # Few shared pairs: only they are touched (a sorted probe). Many (a hot
            # bucket shared across tables, copies): one vectorised comparison.
            lo = np.searchsorted(vals, asked, "left")
            hi = np.searchsorted(vals, asked, "right")
            cnt = hi - lo
            total = int(cnt.sum())
            if total == 0:
                continue
            if blocked is None:
                blocked = np.zeros((nq, nt), dtype=bool)
            if total * 8 > nq * nt:
                np.logical_or(blocked, asked[:, None] == col[None, :], out=blocked)
            else:
                rows = np.repeat(np.arange(nq), cnt)
                offs = np.arange(total) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(lo, cnt)
                blocked[rows, order[offs]] = True
        return blocked

    def _dense(self, qv, q32, qn, tol, tv, t32, tn, exp, blocked):
        """Candidates of rows scored by one float32 matrix product: ``(i, j, exact
        distance, counts)``; for top k the band up to the k-th value plus its margin."""
        # Squared distances by expansion, built in place (one n_q x n_t float32 buffer).
        d2 = q32 @ t32.T
        d2 *= np.float32(-2.0)
        d2 += qn[:, None]
        d2 += tn[None, :]
        np.maximum(d2, np.float32(0.0), out=d2)
        masked = blocked is not None
        if masked:
            np.putmask(d2, blocked, np.float32(np.inf))
        if self.threshold is not None:
            thr2 = float(np.ldexp(float(self.threshold), -exp) ** 2)
            near = np.abs(d2 - thr2) <= tol[:, None]
            out = d2 >= thr2
            if near.any():
                i, j = np.nonzero(near)
                out[i, j] = _exact(qv, tv, i, j) >= self.threshold
            np.putmask(d2, out, np.float32(np.inf))
            masked = True
        counts = np.count_nonzero(np.isfinite(d2), axis=1) if masked else np.full(len(qv), d2.shape[1])
        if self.k is None:
            flat = np.flatnonzero(np.isfinite(d2)) if masked else np.arange(d2.size)
            i, j = np.divmod(flat, d2.shape[1])
            return i, j, _exact(qv, tv, i, j), counts
        kth = _kth_bound(d2, min(self.k, d2.shape[1]))
        # Candidates: everything up to the k-th value (or a bound of it) plus its rounding margin (ties and
        # copies included); exact distances then decide the order (distance, t_id).
        top = np.finfo(np.float32).max  # finite: masked (inf) entries never qualify
        lim = np.minimum(np.where(np.isfinite(kth), kth + tol, top), top).astype(np.float32)
        cand = d2 <= lim[:, None]
        i, j = np.divmod(np.flatnonzero(cand), d2.shape[1])
        if len(i) > WIDE_BAND * self.k * len(qv):
            # Far more candidates than k per query: ties, in practice copies of vectors.
            i, j, dist = self._wide(qv, tv, cand, i, j)
            return i, j, dist, counts
        return i, j, _exact(qv, tv, i, j), counts

    def _wide(self, qv, tv, cand, i, j):
        """The k best of each row when the candidate band is wide (many equal or
        near-equal distances): ``(i, j, exact distance)``.

        Identical vectors are merged first (``np.unique`` on rows), so exact distances
        are computed once per distinct (query vector, training vector) pair: copies cost
        one distance, and equal vectors get bit-equal distances, so ties are broken by
        t_id exactly. The k smallest (distance, t_id) per row are then picked without
        a sort: everything below the k-th distance, then the lowest t_ids at it (columns
        are in t_id order).
        """
        _, q_first, q_uid = np.unique(qv, axis=0, return_index=True, return_inverse=True)
        _, t_first, t_uid = np.unique(tv, axis=0, return_index=True, return_inverse=True)
        q_uid, t_uid = q_uid.ravel(), t_uid.ravel()
        nt = cand.shape[1]
        # Rows with the same vector and the same candidate set (copy queries) pick the
        # same columns: select once per distinct row, then copy to its duplicates.
        row_key = np.concatenate([q_uid.astype(np.int64)[:, None].view(np.uint8),
                                  np.packbits(cand, axis=1)], axis=1)
        _, rep, inv = np.unique(row_key, axis=0, return_index=True, return_inverse=True)
        inv = inv.ravel()
        rep_cand = cand[rep]
        ci, cj = np.divmod(np.flatnonzero(rep_cand), nt)
        n_ut = len(t_first)
        mark = np.zeros((len(q_first), n_ut), dtype=bool)
        mark[q_uid[rep][ci], t_uid[cj]] = True
        ui, uj = np.divmod(np.flatnonzero(mark), n_ut)
        exact_u = np.full(mark.shape, np.inf)
        exact_u[ui, uj] = _exact(qv, tv, q_first[ui], t_first[uj])
        e = exact_u[q_uid[rep][:, None], t_uid[None, :]]
        e[~rep_cand] = np.inf
        kk = min(self.k, nt)
        ek = np.partition(e, kk - 1, axis=1)[:, kk - 1]
        below = e < ek[:, None]
        at = (e == ek[:, None]) & rep_cand
        need = kk - below.sum(axis=1)
        sel = below | (at & (np.cumsum(at, axis=1) <= need[:, None]))
        ri, rj = np.divmod(np.flatnonzero(sel), nt)  # grouped by representative row
        per = np.bincount(ri, minlength=len(rep))
        start = np.cumsum(per) - per
        lengths = per[inv]
        total = int(lengths.sum())
        rows = np.repeat(np.arange(len(inv)), lengths)
        offs = (np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                + np.repeat(start[inv], lengths))
        return rows, rj[offs], e[ri[offs], rj[offs]]


def _earlier(qsig: np.ndarray, tsig: np.ndarray):
    """Buckets of the earlier tables, numbered within the block by a small type:
    ``(queries' numbers, [(order, sorted numbers, numbers) of the training rows] by table)``."""
    codes, earlier = [], []
    for j in range(qsig.shape[1]):
        found, code = np.unique(np.concatenate([qsig[:, j], tsig[:, j]]), return_inverse=True)
        code = code.ravel().astype(np.min_scalar_type(len(found)))
        mine, col = code[:len(qsig)], code[len(qsig):]
        order = np.argsort(col, kind="stable")
        codes.append(mine)
        earlier.append((order, col[order], col))
    return np.stack(codes, axis=1), earlier


def _kth_bound(d2: np.ndarray, kk: int) -> np.ndarray:
    """The k-th least value of each row, or a bound not below it: the k-th least of the least
    values of groups of ``FOLD`` columns. Where fewer than k groups hold a finite value the
    bound is infinite, and at most ``k * FOLD`` values of the row are finite."""
    n = d2.shape[1] // FOLD
    if n < 16 * kk:
        return np.partition(d2, kk - 1, axis=1)[:, kk - 1]
    least = d2[:, :n * FOLD].reshape(len(d2), FOLD, n).min(axis=1)
    least = np.concatenate([least, d2[:, n * FOLD:]], axis=1)
    return np.partition(least, kk - 1, axis=1)[:, kk - 1]


def _exact(qv, tv, i, j) -> np.ndarray:
    """Distances of the pairs (i, j) in float64 from the stored values (exact widening)."""
    if len(i) == 0:
        return np.zeros(0, dtype=np.float64)
    if len(i) > len(qv) + len(tv):  # most vectors are met more than once: widened once
        qv, tv = qv.astype(np.float64, copy=False), tv.astype(np.float64, copy=False)
    out = np.empty(len(i), dtype=np.float64)
    step = max(1, EXACT_VALUES // max(1, qv.shape[1]))
    for s in range(0, len(i), step):
        diff = (qv[i[s:s + step]].astype(np.float64, copy=False)
                - tv[j[s:s + step]].astype(np.float64, copy=False))
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        # Squares outside float64's range: the same sum on the difference scaled by a
        # power of two of its own.
        far = np.flatnonzero(~((d > 1e-140) & (d < 1e140)))
        if len(far):
            e = np.frexp(np.abs(diff[far]).max(axis=1, initial=0.0))[1]
            scaled = np.ldexp(diff[far], -e[:, None])
            d[far] = np.ldexp(np.sqrt(np.einsum("ij,ij->i", scaled, scaled)), e)
        out[s:s + step] = d
    return out


def _table(qid, tid, tlab, dist, n) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array(qid, pa.int64()), pa.array(tid, pa.int64()), tlab,
         pa.array(dist, pa.float64()), pa.array(n, pa.int64())],
        names=["q_id", "t_id", "t_label", "distance", "n_cand"])


def partitions_for(spark, rows: int, width: float, value_bytes: int = 8) -> int:
    """Cogroup partitions: the session's setting, raised so a partition holds about
    ``PARTITION_BYTES`` at most, from the shuffled rows (copies included) and the bytes
    of a row of ``width`` components."""
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, math.ceil(rows * (width * value_bytes + ROW_OVERHEAD) / PARTITION_BYTES))


def run_blocks(q_side: DataFrame, t_side: DataFrame, keys: list[str],
               kernel: BlockKernel, n_partitions: int | None = None,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """Cogroup both sides on ``keys`` and run ``kernel`` per group (Arrow in and out).
    ``carry`` names integer keys that the result rows keep.

    Both sides are hash-partitioned on the keys into ``n_partitions`` (default: the
    session's shuffle partitions) explicitly: that is the cogroup's own distribution (no
    extra exchange), and unlike an automatic shuffle AQE does not merge it into a few
    partitions when the input is small in bytes, which would leave most cores idle in
    this compute-heavy stage.
    """
    n = n_partitions or int(q_side.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    label = t_side.schema["t_label"].dataType.simpleString()

    def per_group(q: pa.Table, t: pa.Table) -> pa.Table:
        out = kernel(q, t)
        for c in carry:
            value = q.column(c)[0].as_py() if out.num_rows else 0
            out = out.append_column(c, pa.array(np.full(out.num_rows, value, dtype=np.int32)))
        return out

    schema = KERNEL_SCHEMA.format(label=label) + "".join(f", {c} int" for c in carry)
    return (q_side.repartition(n, *keys).groupBy(*keys)
            .cogroup(t_side.repartition(n, *keys).groupBy(*keys))
            .applyInArrow(per_group, schema))
