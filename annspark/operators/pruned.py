"""Exact k-NN that skips blocks by the triangle inequality.

A bounded sample of training rows gives pivots. Every training row goes to the cell of its
nearest pivot, and cells with more than a block of rows are cut into rings by distance to the
pivot. A ring is known by its distance range: no row of it can be nearer to a query than
the gap between the query's own distance to the pivot and that range, nor nearer than half
the difference between the query's distances to the ring's pivot and to its nearest one.

Two rounds of the block kernel, no guess: each query first searches the ring with the
smallest bound that holds k rows, which gives it a k-th distance; then all rings whose
bound is not above it, and no other. Rings of many rows are cut into blocks by a hash, as
are the queries that meet in one, so a cell that holds a third of all rows is many tasks.
A query goes to a ring as a row with its vector, so rings are few: at most ``MAX_RINGS`` and
one more a pivot, whatever the table, which also bounds what is broadcast. Where nothing can
be ruled out, that many rows a query are written; rings grow with the table, not in number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annspark.functions.hashing import arrow_matrix
from annspark.functions.sparse import is_sparse
from annspark.functions.vectors import search_width
from annspark.operators.blocks import (
    DEFAULT_BLOCK_ROWS,
    DEFAULT_MAX_BROADCAST_ROWS,
    BlockKernel,
    block_size,
    count_rows,
    join_checked,
    partitions_for,
    run_blocks,
)
from annspark.operators.search import _sides
from annspark.operators.topk import merge_top_k
from annspark.session import scratch_path

MAX_PIVOTS = 128
MAX_RINGS = 128
SLACK = 1e-6  # of the norms: covers the rounding of distances to pivots
CHUNK_VALUES = 500_000  # bounds of queries to rings held at a time
BATCH_ROWS = 8192  # queries with their rings that are handed on at a time


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


class Rings:
    """Ranges of the rings and the bounds of queries to them."""

    def __init__(self, pivots: np.ndarray, cell, ring, n, low, high):
        self.pivots, self.cell, self.ring, self.n = pivots, cell, ring, n
        self.low, self.high = low, high

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """``(rows, rings)``: no row of the ring is nearer than this."""
        with np.errstate(over="ignore", invalid="ignore"):
            d = _to_pivots(x, self.pivots)
            to = d[:, self.cell]
            gap = np.maximum(to - self.high, self.low - to)
            half = (to - d.min(axis=1, initial=np.inf)[:, None]) / 2
            norm = np.sqrt((x * x).sum(axis=1)) + np.sqrt((self.pivots ** 2).sum(axis=1)).max(initial=0)
            out = np.maximum(np.maximum(gap, half) - SLACK * (norm + d.max(axis=1, initial=0))[:, None], 0.0)
        return np.where(np.isfinite(out), out, 0.0)

    def home(self, k: int):
        """Task code: each query with the ring of least bound that holds ``k`` rows."""
        if not len(self.n):
            return lambda batches: iter(())
        full = np.flatnonzero(self.n >= k)
        places = full if len(full) else np.arange(len(self.n))

        def run(batches):
            for batch in batches:
                x = arrow_matrix(batch.column("q_vec"))
                best = np.empty(len(x), dtype=np.int64)
                for s in range(0, len(x), self.step()):
                    best[s:s + self.step()] = places[self.bounds(x[s:s + self.step()])[:, places].argmin(axis=1)]
                yield from self.rows(batch, np.arange(len(x)), best)
        return run

    def others(self):
        """Task code: each query with every ring but its home whose bound is within ``tau``."""
        def run(batches):
            for batch in batches:
                x, tau = arrow_matrix(batch.column("q_vec")), batch.column("tau").to_numpy(zero_copy_only=False)
                cell, ring = batch.column("cell").to_numpy(), batch.column("ring").to_numpy()
                for s in range(0, len(x), self.step()):
                    e = s + self.step()
                    near = self.bounds(x[s:e]) <= tau[s:e, None]
                    near &= (cell[s:e, None] != self.cell) | (ring[s:e, None] != self.ring)
                    i, j = np.nonzero(near)
                    yield from self.rows(batch, i + s, j)
        return run

    def step(self) -> int:
        return max(1, CHUNK_VALUES // max(1, len(self.cell)))

    def rows(self, batch, i: np.ndarray, j: np.ndarray):
        for s in range(0, len(i), BATCH_ROWS):
            at, to = pa.array(i[s:s + BATCH_ROWS], pa.int64()), j[s:s + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("q_id").take(at), batch.column("q_vec").take(at), pa.array(self.cell[to], pa.int32()),
                 pa.array(self.ring[to], pa.int32())], names=["q_id", "q_vec", "cell", "ring"])


class PrunedSearch:
    """Training rows dealt into rings, ready for searches; ``rings`` rows are written."""

    def __init__(self, query: DataFrame, train: DataFrame, k: int, exclude_self: bool = False,
                 n_pivots: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS, id_col: str = "id",
                 features: str = "features", label: str = "label", max_rings: int = MAX_RINGS):
        if is_sparse(train, features):
            raise ValueError("pruned search takes vectors as arrays")
        if k < 1:
            raise ValueError("k must be >= 1")
        self.k, self.exclude_self = k, exclude_self
        self.query, t = _sides(query, train, id_col, features, label)
        self.n_q, self.n_t = count_rows(query.select(id_col), train.select(id_col))
        self.width = search_width(train, query, col=features)
        self.block_rows = block_size(block_rows, max(self.n_q, self.n_t), 8 * self.width)
        n = n_pivots or min(MAX_PIVOTS, max(1, math.isqrt(self.n_t) // 2))
        sample = t.select("t_vec", F.xxhash64("t_id").alias("h")).orderBy("h").limit(n).collect()
        # Without a training row one pivot at zero stands for the rings, of which there are none.
        pivots = np.array([r["t_vec"] for r in sample] or [[0.0] * self.width], dtype=np.float64)
        self._deal(t, pivots, max(block_rows, -(-self.n_t // max_rings)))

    def _deal(self, t: DataFrame, pivots: np.ndarray, ring_rows: int) -> None:
        width = self.width

        @F.arrow_udf("struct<cell:int,d:double>")
        def nearest(v: pa.Array) -> pa.Array:
            x = arrow_matrix(v, width)
            cell = _to_pivots(x, pivots).argmin(axis=1)
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d)], names=["cell", "d"])

        dealt = _written(t.withColumn("_at", nearest("t_vec")).select("t_id", "t_vec", "t_label", "_at.*"), "cells")
        cells = dealt.groupBy("cell").agg(  # at most one row per pivot
            F.ceil(F.count(F.lit(1)) / ring_rows).cast("int").alias("_nr"),
            F.min("d").alias("_lo"), F.max("d").alias("_hi"))
        part = F.when(F.col("_hi") > F.col("_lo"), (F.col("d") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        ring = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * F.col("_nr")), F.col("_nr") - 1).cast("int")
        dealt = dealt.join(F.broadcast(cells), "cell").withColumn("ring", ring).drop("_nr", "_lo", "_hi")
        # Cells cut in ceil(n / ring_rows) rings: at most ``max_rings`` and one more a pivot.
        found = dealt.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"),
                                                  F.max("d").alias("high")).toArrow()
        columns = [found.column(c).to_numpy() for c in ("cell", "ring", "n", "low", "high")]
        self.rings = Rings(pivots, *columns)
        blocks = [(int(c), int(r), math.ceil(n / self.block_rows)) for c, r, n, *_ in zip(*columns)]
        sizes = t.sparkSession.createDataFrame(blocks, "cell int, ring int, nb int")
        self.train = (dealt.drop("d").join(F.broadcast(sizes), ["cell", "ring"])
                      .withColumn("sub", F.pmod(F.xxhash64("t_id"), F.col("nb")).cast("int")).drop("nb"))
        self.sizes = sizes

    def home(self) -> DataFrame:
        return self.query.mapInArrow(self.rings.home(self.k + self.exclude_self), self._schema())

    def others(self, home: DataFrame, tau: DataFrame) -> DataFrame:
        """Rows ``q_id, q_vec, cell, ring`` of all further rings a query must search."""
        asked = home.join(tau, "q_id", "left").fillna(float("inf"), subset=["tau"])
        return asked.mapInArrow(self.rings.others(), self._schema())

    def _schema(self) -> str:
        return f"q_id long, q_vec {self.query.schema['q_vec'].dataType.simpleString()}, cell int, ring int"

    def met(self, asked: DataFrame) -> tuple[DataFrame, int]:
        """Kernel output of queries against the rings they name, and its partitions."""
        per_ring = asked.groupBy("cell", "ring").agg(
            F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int").alias("nq"))
        # One row per ring at most.
        q = (join_checked(asked.join(F.broadcast(self.sizes), ["cell", "ring"]), per_ring, ["cell", "ring"], "inner",
                          DEFAULT_MAX_BROADCAST_ROWS, "q_id")
             .withColumn("qblock", F.pmod(F.xxhash64("q_id"), F.col("nq")).cast("int"))
             .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "nq"))
        t = (join_checked(self.train, per_ring, ["cell", "ring"], "inner", DEFAULT_MAX_BROADCAST_ROWS, "t_id")
             .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq"))
        # Queries go to each block of a ring, training rows to each block of its queries.
        copies = asked.count() + 2 * self.n_t * math.ceil(self.n_q / self.block_rows)
        n = partitions_for(asked.sparkSession, copies, self.width)
        kernel = BlockKernel(self.k, None, self.exclude_self, first_table=False)
        return run_blocks(q, t, ["cell", "ring", "sub", "qblock"], kernel, n), n

    def search(self) -> DataFrame:
        """``q_id, t_id, t_label, distance, rn, n_compared``."""
        home = _written(self.home(), "home-rings")
        raw, n = self.met(home)
        first = _written(raw, "home-neighbours")
        best = merge_top_k(first, self.k, n)
        tau = best.where(F.col("rn") == self.k).select("q_id", F.col("distance").alias("tau"))
        more, n = self.met(_written(self.others(home, tau), "further-rings"))
        merged = merge_top_k(more.unionByName(first), self.k, 2 * n)
        return merged.withColumnRenamed("n_candidates", "n_compared")

    def report(self) -> DataFrame:
        """One row: ``n_pairs`` of queries and rings, and ``n_searched`` of them."""
        home = _written(self.home(), "home-rings")
        raw, n = self.met(home)
        best = merge_top_k(raw, self.k, n)
        tau = best.where(F.col("rn") == self.k).select("q_id", F.col("distance").alias("tau"))
        further = self.others(home, tau).select(F.lit(1).alias("_n"))
        both = home.select(F.lit(1).alias("_n")).unionByName(further)
        return both.agg((F.lit(self.n_q) * F.lit(len(self.rings.n))).cast("long").alias("n_pairs"),
                        F.count("_n").alias("n_searched"))


def exact_knn_pruned(query: DataFrame, train: DataFrame, k: int = 5, exclude_self: bool = False,
                     **opts) -> DataFrame:
    """Exact k nearest neighbours, skipping what the triangle inequality rules out:
    ``q_id, t_id, t_label, distance, rn, n_compared`` (training rows compared)."""
    return PrunedSearch(query, train, k, exclude_self, **opts).search()
