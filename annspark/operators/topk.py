"""Mergeable top k: one bounded array per query, merged level by level.

Search kernels emit up to k rows per query and block, with the query's candidate count of
the block on its first row. ``merge_top_k`` brings them together without a window over all
block rows:

* inside each map task the rows are sorted by query (Spark's sort, which spills) and packed
  to one row per query: an array of its k best ``(distance, t_id, t_label)`` and the summed
  count. Only that row is shuffled, so an exchange sees at most one row of k entries per
  query and map task, however many blocks met in the task;
* an aggregate per query merges the arrays and sums the counts. One merge meets at most
  ``FAN_IN`` arrays: with more map tasks, the arrays of groups of tasks are merged first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 256


class PackTopK:
    """Rows sorted by query to one row per query: the keys ``by``, ``n_cand, best``. Holds
    the rows of one query at a time, cut to k."""

    def __init__(self, k: int, by: tuple[str, ...] = ("q_id",)):
        self.k, self.by = k, by

    def starts(self, keys: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(keys[0]), dtype=bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        return np.flatnonzero(new)

    def __call__(self, batches):
        open_rows = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if open_rows is not None:
                rows = pa.concat_tables([open_rows, rows])
            if rows.num_rows == 0:
                continue
            kept = self.cut(rows)
            last = int(self.starts([kept.column(c).to_numpy() for c in self.by])[-1])
            open_rows = kept.slice(last)  # its query may go on in the next batch
            yield from self.packed(kept.slice(0, last))
        if open_rows is not None:
            yield from self.packed(open_rows)

    def cut(self, rows: pa.Table) -> pa.Table:
        """The k best rows of each query, in order; counts summed on the first row."""
        t, d, n = (rows.column(c).to_numpy() for c in ("t_id", "distance", "n_cand"))
        keys = [rows.column(c).to_numpy() for c in self.by]
        order = np.lexsort((t, d, *reversed(keys)))
        start = self.starts([key[order] for key in keys])
        lengths = np.diff(np.r_[start, len(order)])
        rank = np.arange(len(order)) - np.repeat(start, lengths)
        total = np.zeros(len(order), dtype=np.int64)
        total[start] = np.add.reduceat(n[order], start)
        keep = rank < self.k
        rows = rows.take(pa.array(order[keep]))
        return rows.set_column(rows.column_names.index("n_cand"), "n_cand", pa.array(total[keep]))

    def packed(self, rows: pa.Table):
        if rows.num_rows == 0:
            return
        rows = rows.combine_chunks()
        keys = [rows.column(c).to_numpy() for c in self.by]
        start = self.starts(keys)
        entries = pa.StructArray.from_arrays(
            [rows.column(c).combine_chunks() for c in ("distance", "t_id", "t_label")],
            names=["distance", "t_id", "t_label"])
        best = pa.ListArray.from_arrays(pa.array(np.r_[start, rows.num_rows].astype(np.int32)), entries)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(key[start]) for key in keys], pa.array(rows.column("n_cand").to_numpy()[start]), best],
            names=[*self.by, "n_cand", "best"])


def pack_top_k(raw: DataFrame, k: int, by: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """``q_id, n_cand, best`` of ``raw`` (``q_id, t_id, t_label, distance, n_cand``): at most
    one row per query and task, without a shuffle. ``by`` names the integer columns that
    make a query."""
    label = raw.schema["t_label"].dataType.simpleString()
    keys = ", ".join(f"{c} {raw.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}, n_cand long, best array<struct<distance:double,t_id:long,t_label:{label}>>"
    return raw.sortWithinPartitions(*by).mapInArrow(PackTopK(k, by), schema)


def _merged(packed: DataFrame, k: int, *keys: str) -> DataFrame:
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return packed.groupBy(*keys).agg(F.sum("n_cand").alias("n_cand"), best.alias("best"))


def merge_top_k(raw: DataFrame, k: int, n_tasks: int, fan_in: int = FAN_IN,
                by: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """``q_id, t_id, t_label, distance, rn, n_candidates``: the k best rows of each query,
    order distance then t_id. ``n_tasks`` is the number of partitions of ``raw``."""
    packed = pack_top_k(raw, k, by)
    if n_tasks > fan_in:
        lanes = -(-n_tasks // fan_in)
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes))
        packed = _merged(packed.withColumn("_lane", lane), k, *by, "_lane").drop("_lane")
    # The _outer form keeps Catalyst from adding a size filter that would merge twice.
    return (_merged(packed, k, *by)
            .select(*by, "n_cand", F.posexplode_outer("best").alias("_pos", "b"))
            .select(*by, "b.t_id", "b.t_label", "b.distance", (F.col("_pos") + 1).alias("rn"),
                    F.col("n_cand").alias("n_candidates")))
