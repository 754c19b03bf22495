"""LSH k-NN with late materialisation: candidates on one-byte codes, vectors fetched once.

``knn_join`` shuffles a vector once per table. Here the exploded rows carry a code instead:
a byte per component, a scale, and the exact length of what the code leaves out, which
bounds every distance from below and above. Hashing and coding are one pass over each
table, stored without vectors.

1. Bucket sizes of both sides, from signatures alone, give the buckets that hold rows of both;
   rows of other buckets, of either side, are dropped before the shuffle.
2. Blocks of codes emit, per query, the pairs whose lower bound is not above the block's
   k-th upper bound, each pair at the first table it shares. Of equal vectors only the k
   smallest ids can be among the k nearest.
3. Over all blocks of a query the k-th upper bound cuts the pairs again.
4. The vectors of the pairs left are fetched by id, and exact distances rank them.

Where codes cannot tell rows apart (many near copies), a query would emit much of a block.
Beyond ``max_pairs`` it names the block instead, and those blocks alone are compared on
vectors, by the kernel of ``knn_join``. Ids are taken to be unique within a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annspark.functions.hashing import arrow_matrix, project
from annspark.functions.sparse import is_sparse
from annspark.functions.vectors import search_width
from annspark.operators.blocks import (
    DEFAULT_BLOCK_ROWS,
    DEFAULT_MAX_BROADCAST_ROWS,
    MERGE_ROWS,
    BlockKernel,
    _earlier,
    _exact,
    block_size,
    count_rows,
    join_checked,
    partitions_for,
    run_blocks,
)
from annspark.operators.search import _sides
from annspark.operators.topk import merge_top_k
from annspark.session import scratch_path

MAX_PAIRS = 16  # times k: pairs a query may emit from a block
KEYS = ["tbl", "bgroup", "tblock", "qblock"]
_PAIRS = ("q_id long, t_id long, lower double, upper double, n_cand long, tbl int, bgroup int, tblock int, "
          "qblock int")


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes int8, scale, error)``: ``|x - codes * scale| <= error`` row by row."""
    scale = np.abs(x).max(axis=1, initial=0.0) / 127.0
    safe = np.where(scale > 0, scale, 1.0)
    codes = np.clip(np.rint(x / safe[:, None]), -127, 127)
    e = np.frexp(np.where(scale > 0, scale, 1.0))[1]  # squares of the rest stay in range
    rest = np.ldexp(x - codes * safe[:, None], -e[:, None])
    error = np.ldexp(np.sqrt((rest * rest).sum(axis=1)), e) * (1 + 1e-9) + 4e-16 * scale * 127 * np.sqrt(x.shape[1])
    return codes.astype(np.int8), scale, error


def decode(codes, scale: np.ndarray, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.int8).reshape(-1, width)
    return raw * scale[:, None]


class CodeKernel(BlockKernel):
    """Pairs of a block that may be among a query's k nearest, with bounds of their distances."""

    def __init__(self, k: int, exclude_self: bool, width: int, max_pairs: int):
        super().__init__(k, None, exclude_self, first_table=True)
        self.width, self.max_pairs = width, max_pairs

    def __call__(self, q: pa.Table, t: pa.Table) -> pa.Table:
        keys = [int(q.column(c)[0].as_py()) for c in KEYS] if q.num_rows else [0] * len(KEYS)
        parts = [[np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)] * 2 + [np.zeros(0, dtype=np.int64)]]
        if q.num_rows and t.num_rows:
            parts += self._blocks(q, t.sort_by("t_id"), keys[0])
        columns = [np.concatenate(c) for c in zip(*parts)]
        names = [f.split()[0] for f in _PAIRS.split(", ")]
        return pa.table([pa.array(c) for c in columns] +
                        [pa.array(np.full(len(columns[0]), key, dtype=np.int32)) for key in keys], names=names)

    def _blocks(self, q, t, tbl: int):
        (qx, qe, qb, _), (tx, te, tb, same) = self._side(q, "q"), self._side(t, "t")
        qid, tid = q.column("q_id").to_numpy(), t.column("t_id").to_numpy()
        exp = int(np.frexp(max(np.abs(qx).max(initial=0.0), np.abs(tx).max(initial=0.0)))[1])
        q32, t32 = (np.ldexp(x, -exp).astype(np.float32) for x in (qx, tx))
        qn, tn = ((x * x).sum(axis=1) for x in (q32, t32))
        err = 4.0 * (self.width + 8) * float(np.finfo(np.float32).eps)
        earlier, qsig = [], None
        if tbl:
            qsig, earlier = _earlier(*(arrow_matrix(s.column(f"{p}_sig"), dtype=np.int64)[:, :tbl]
                                       for s, p in ((q, "q"), (t, "t"))))
        # Of equal vectors the k smallest ids (one more: a query may be among them) go on.
        spare = _place_in_class(same) >= self.k + self.exclude_self
        step = max(1, self.chunk_values // max(1, len(tx)))
        for s in range(0, len(qx), step):
            e = min(len(qx), s + step)
            blocked = self._blocked(qid[s:e], tid, None if qsig is None else qsig[s:e], earlier, e - s, len(tx))
            other = qb[s:e, None] != tb[None, :]
            dead = other if blocked is None else other | blocked
            n = len(tx) - np.count_nonzero(dead, axis=1)
            d2 = qn[s:e, None] + tn[None, :] - 2.0 * (q32[s:e] @ t32.T)
            tol = (err * (qn[s:e, None] + float(tn.max())) + 1e-30).astype(np.float32)
            off = (np.ldexp(qe[s:e], -exp)[:, None] + np.ldexp(te, -exp)[None, :]).astype(np.float32) * np.float32(1.001)
            upper = np.sqrt(np.maximum(d2, 0) + tol) + off
            lower = np.sqrt(np.maximum(d2 - tol, 0)) - off
            upper[dead | spare[None, :]] = np.inf
            kk = min(self.k, len(tx))
            cut = np.partition(upper, kk - 1, axis=1)[:, kk - 1]
            near = (lower <= cut[:, None]) & np.isfinite(upper)
            yield self._found(near, lower, upper, n, qid[s:e], tid, exp)

    def _side(self, rows: pa.Table, p: str):
        scale = rows.column("scale").to_numpy()
        x = decode(rows.column("code").combine_chunks(), scale, self.width)
        return x, rows.column("err").to_numpy(), rows.column("bucket").to_numpy(), rows.column("same").to_numpy()

    def _found(self, near, lower, upper, n, qid, tid, exp):
        many = near.sum(axis=1) > self.max_pairs * self.k
        near[many] = False
        i, j = np.nonzero(near)
        start = np.zeros(len(i), dtype=bool)
        start[:1] = True
        start[1:] = i[1:] != i[:-1]
        unit = float(np.ldexp(1.0, exp))
        low = np.maximum(lower[i, j].astype(np.float64), 0.0) * unit
        named = np.flatnonzero(many)  # the block is to be compared on vectors: no pair, no count
        return [np.r_[qid[i], qid[named]], np.r_[tid[j], np.full(len(named), -1)],
                np.r_[low, np.zeros(len(named))], np.r_[upper[i, j].astype(np.float64) * unit, np.full(len(named), np.nan)],
                np.r_[np.where(start, n[i], 0), np.full(len(named), -1)].astype(np.int64)]


def _place_in_class(same: np.ndarray) -> np.ndarray:
    """Position of each row among the rows of its class, in the order given."""
    order = np.argsort(same, kind="stable")
    s = same[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    return out


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _coded(side: DataFrame, p: str, family, width: int) -> DataFrame:
    """``{p}_id, sig, code, scale, err, same`` of a side: hashing and coding in one pass.
    ``same`` is a hash of the vector's values."""
    directions = family.directions(family.planes(width))

    def run(batches):
        for batch in batches:
            vec = batch.column(f"{p}_vec")
            x = arrow_matrix(vec, width)
            sig = family.buckets(project(vec, width, directions)).reshape(len(x), family.n_tables)
            codes, scale, error = encode(x)
            offsets = pa.array(np.arange(0, sig.size + 1, family.n_tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f"{p}_id"), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel().astype(np.int64))),
                 pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(scale), pa.array(error),
                 batch.column("same")], names=[f"{p}_id", "sig", "code", "scale", "err", "same"])

    # Equal values hash alike: -0.0 counts as 0.0, and both sides are hashed as doubles.
    whole = F.transform(F.col(f"{p}_vec"), lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double")))
    return side.select(f"{p}_id", f"{p}_vec", F.xxhash64(whole).alias("same")).mapInArrow(
        run, f"{p}_id long, sig array<bigint>, code binary, scale double, err double, same long")


class LateSearch:
    """Coded tables and their live buckets, and the steps of the search."""

    def __init__(self, query: DataFrame, train: DataFrame, family, k: int = 5, exclude_self: bool = False,
                 id_col: str = "id", features: str = "features", label: str = "label",
                 block_rows: int = DEFAULT_BLOCK_ROWS, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                 max_pairs: int = MAX_PAIRS):
        if is_sparse(train, features):
            raise ValueError("late materialisation takes vectors as arrays")
        if k < 1:
            raise ValueError("k must be >= 1")
        self.family, self.k, self.exclude_self = family, k, exclude_self
        self.max_broadcast_rows, self.max_pairs = max_broadcast_rows, max_pairs
        self.q, self.t = _sides(query, train, id_col, features, label)
        self.spark = query.sparkSession
        self.n_q, self.n_t = count_rows(query.select(id_col), train.select(id_col))
        self.width = search_width(train, query, col=features)
        self.block_rows = block_size(block_rows, max(self.n_q, self.n_t), 8 * self.width)
        self.q_codes = _stored(_coded(self.q, "q", family, self.width), "query-codes")
        self.t_codes = _stored(_coded(self.t, "t", family, self.width), "row-codes")
        self.live = self._live()

    def _live(self) -> DataFrame:
        """Buckets that hold rows of both sides, with their numbers of blocks."""
        def each(df, n_t, n_q):
            return df.select(F.posexplode_outer("sig").alias("tbl", "bucket")).select(
                "tbl", "bucket", F.lit(n_t).alias("n_t"), F.lit(n_q).alias("n_q"))

        sizes = (each(self.t_codes, 1, 0).unionByName(each(self.q_codes, 0, 1)).groupBy("tbl", "bucket")
                 .agg(F.sum("n_t").alias("n_t"), F.sum("n_q").alias("n_q")))
        live = _stored(sizes.where("n_t > 0 and n_q > 0").select(
            "tbl", "bucket", F.ceil(F.col("n_t") / self.block_rows).cast("int").alias("n_tb"),
            F.ceil(F.col("n_q") / self.block_rows).cast("int").alias("n_qb"), "n_t", "n_q"), "live-buckets")
        # Rows shuffled: each goes to every block of the other side.
        copies = F.sum(F.col("n_t") * F.col("n_qb") + F.col("n_q") * F.col("n_tb"))
        self.copies = int(live.agg(copies).first()[0] or 0)
        return live.drop("n_t", "n_q")

    def exploded(self, p: str) -> DataFrame:
        """Coded rows of side ``p`` per live bucket and block: what is shuffled."""
        df = self.q_codes if p == "q" else self.t_codes
        rows = (df.select("*", F.posexplode_outer("sig").alias("tbl", "bucket"))
                .withColumn(f"{p}_sig", F.slice("sig", 1, F.col("tbl"))).drop("sig"))
        rows = join_checked(rows, self.live, ["tbl", "bucket"], "inner", self.max_broadcast_rows, f"{p}_id")
        own, other = ("qblock", "tblock") if p == "q" else ("tblock", "qblock")
        own_n, other_n = ("n_qb", "n_tb") if p == "q" else ("n_tb", "n_qb")
        groups = max(1, -(-(self.n_q + self.n_t) // min(MERGE_ROWS, self.block_rows)))
        return (rows.withColumn("bgroup", F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("int"))
                .withColumn(own, F.pmod(F.xxhash64(f"{p}_id"), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("n_tb", "n_qb"))

    def pairs(self) -> tuple[DataFrame, int]:
        q, t = self.exploded("q"), self.exploded("t")
        n = partitions_for(self.spark, self.copies, self.width, 1)
        kernel = CodeKernel(self.k, self.exclude_self, self.width, self.max_pairs)
        met = (q.repartition(n, *KEYS).groupBy(*KEYS).cogroup(t.repartition(n, *KEYS).groupBy(*KEYS))
               .applyInArrow(lambda a, b: kernel(a, b), _PAIRS))
        return _stored(met, "code-pairs"), n

    def on_vectors(self, named: DataFrame) -> tuple[DataFrame, int]:
        """The blocks that queries named, compared on vectors."""
        plain = ["code", "scale", "err", "same"]
        q = (self.exploded("q").drop(*plain).join(named.select("q_id", *KEYS), ["q_id", *KEYS], "left_semi")
             .join(self.q, "q_id"))
        blocks = named.select(*KEYS).distinct()
        t = join_checked(self.exploded("t").drop(*plain), blocks, KEYS, "left_semi", self.max_broadcast_rows)
        t = t.join(self.t, "t_id")
        n = partitions_for(self.spark, self.copies, self.width)
        kernel = BlockKernel(self.k, None, self.exclude_self, first_table=True)
        return run_blocks(q, t, KEYS, kernel, n), n

    def search(self) -> DataFrame:
        """As ``knn_join``: ``q_id, t_id, t_label, distance, rn, n_candidates``."""
        pairs, n = self.pairs()
        found = pairs.where("n_cand >= 0").select("q_id", "t_id", "lower", "upper", "n_cand")
        named = pairs.where("n_cand < 0")
        if not named.isEmpty():
            exact, more = self.on_vectors(named)
            exact = _stored(exact, "vector-pairs")
            found = found.unionByName(exact.select("q_id", "t_id", F.col("distance").alias("lower"),
                                                   F.col("distance").alias("upper"), "n_cand"))
            n += more
        tops = _stored(merge_top_k(found.select("q_id", "t_id", F.lit(None).cast("int").alias("t_label"),
                                                F.col("upper").alias("distance"), "n_cand"), self.k, n), "bounds")
        counts = tops.groupBy("q_id").agg(
            F.max("n_candidates").alias("n_candidates"),
            F.max(F.when(F.col("rn") == self.k, F.col("distance"))).alias("cut"))
        left = found.join(counts, "q_id").where(F.col("cut").isNull() | (F.col("lower") <= F.col("cut")))
        left = left.select("q_id", "t_id", "n_candidates")

        @F.arrow_udf("double")
        def exact_distance(a: pa.Array, b: pa.Array) -> pa.Array:
            x, y = arrow_matrix(a, dtype=None), arrow_matrix(b, dtype=None)
            at = np.arange(len(x))
            return pa.array(_exact(x, y, at, at))

        # Each vector once: pairs meet training rows by id, then queries.
        fetched = left.join(self.t, "t_id").join(self.q, "q_id")
        ranked = fetched.select("q_id", "t_id", "t_label", exact_distance("q_vec", "t_vec").alias("distance"),
                                "n_candidates")
        order = Window.partitionBy("q_id").orderBy("distance", "t_id")
        return (ranked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= self.k)
                .select("q_id", "t_id", "t_label", "distance", "rn", "n_candidates"))


def late_knn_join(query: DataFrame, train: DataFrame, family, k: int = 5, exclude_self: bool = False,
                  **opts) -> DataFrame:
    """``knn_join`` (no threshold) with the vectors fetched last. Same rows, same order."""
    return LateSearch(query, train, family, k, exclude_self, **opts).search()
