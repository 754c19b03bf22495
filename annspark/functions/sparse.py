"""Sparse vectors: ``struct<size int, indices array<int>, values array<double or float>>``.

Indices are 0-based, ascending and distinct; what is not listed is zero. Searches, hashes and
indexes take such a column wherever they take an array of numbers: rows are shuffled in
this form, projected entry by entry, and only a block's own columns ever become dense.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Products made at a time when rows are projected, and dense values of a block's matrices.
CHUNK_VALUES = 1_000_000
DENSE_VALUES = 8_000_000


def sparse_vector(size, indices: Column, values: Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.struct(size.cast("int").alias("size"), indices.alias("indices"), values.alias("values"))


def to_sparse(c) -> Column:
    """An array of numbers as a sparse vector (zeros left out)."""
    v = F.col(c) if isinstance(c, str) else c
    places = F.filter(F.transform(v, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return sparse_vector(F.size(v), places, F.filter(v, lambda x: x != 0))


def is_sparse(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, T.StructType) and {"size", "indices", "values"} <= set(kind.names)


def sparse_rows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, indices, values)`` of an Arrow column of sparse vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fields = dict(zip([f.name for f in column.type], column.flatten()))
    lengths = pc.list_value_length(fields["indices"]).to_numpy(zero_copy_only=False)
    if (lengths != pc.list_value_length(fields["values"]).to_numpy(zero_copy_only=False)).any():
        raise ValueError("a sparse vector has more indices than values or fewer")
    indices = fields["indices"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.r_[0, np.cumsum(lengths)].astype(np.int64), indices,
            fields["values"].flatten().to_numpy(zero_copy_only=False))


def sparse_product(column, directions: np.ndarray) -> np.ndarray:
    """Rows of ``column`` times the rows of ``directions``: ``(n, len(directions))``."""
    ends, indices, values = sparse_rows(column)
    by_entry = np.ascontiguousarray(directions.T)
    out = np.zeros((len(ends) - 1, len(directions)))
    step = max(1, CHUNK_VALUES // max(1, len(directions)))
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for s in range(0, len(indices), step):
        r = row[s:s + step]
        products = by_entry[indices[s:s + step]] * values[s:s + step, None].astype(np.float64)
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[start]] += np.add.reduceat(products, start, axis=0)
    return out


def block_matrices(q, t) -> tuple[np.ndarray, np.ndarray] | None:
    """Both sides of a block as dense matrices over the columns that occur in it (distances
    stay what they are), or None when these would hold over ``DENSE_VALUES`` values."""
    sides = [sparse_rows(q), sparse_rows(t)]
    used = np.unique(np.concatenate([indices for _, indices, _ in sides]))
    rows = [len(ends) - 1 for ends, _, _ in sides]
    if sum(rows) > 2 and sum(rows) * len(used) > DENSE_VALUES:
        return None
    out = []
    for n, (ends, indices, values) in zip(rows, sides):
        dense = np.zeros((n, max(1, len(used))), dtype=values.dtype if len(values) else np.float64)
        dense[np.repeat(np.arange(n), np.diff(ends)), np.searchsorted(used, indices)] = values
        out.append(dense)
    return out[0], out[1]


def distances_to(column, key: np.ndarray) -> np.ndarray:
    """Distances of sparse rows to one dense vector."""
    ends, indices, values = sparse_rows(column)
    k = key[indices]
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    n = len(ends) - 1
    met = np.bincount(row, weights=(values - k) ** 2, minlength=n)
    rest = np.maximum((key * key).sum() - np.bincount(row, weights=k * k, minlength=n), 0.0)
    return np.sqrt(met + rest)
