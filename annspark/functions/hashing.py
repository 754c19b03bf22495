"""LSH families and their hash columns.

Two families, both seeded so that runs repeat exactly:

* ``SignFamily`` (random hyperplanes): ``n_bits`` Gaussian planes per table, bit =
  ``plane . v >= 0``, the bits of a table packed into one long (bit j has weight 2^j).
* ``EuclideanFamily`` (2-stable, bucketed projections): one unit-length Gaussian
  direction per table, bucket = ``floor(direction . v / bucket_length)``.

Table ``t`` draws its planes from ``numpy.random.default_rng([seed, t])``, so a family
with more tables extends one with fewer (same first tables). The planes are built once on
the driver (their size is ``n_tables * n_bits * width`` doubles, fixed by parameters)
and shipped in the UDF closure. Hashing is one matrix product per Arrow batch.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annspark.functions.sparse import sparse_product

# Defaults of the reference's command-line flags.
DEFAULT_SEED = 1234
DEFAULT_SIGN_BITS = 5
DEFAULT_SIGN_TABLES = 5
DEFAULT_BUCKET_LENGTH = 2.0
DEFAULT_EUCLID_TABLES = 3

MAX_PLANE_VALUES = 50_000_000  # 400 MB of doubles: refuse larger closures


def arrow_matrix(arr, width: int | None = None, dtype=np.float64) -> np.ndarray:
    """A list Arrow column as an (n, width) matrix (no per-row Python).

    ``dtype=None`` keeps the stored element type (float32 stays float32).
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, width or 0), dtype=dtype or np.float64)
    if arr.null_count:
        raise ValueError("null vector in input")
    lengths = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    w = int(lengths[0]) if width is None else width
    if (lengths != w).any():
        raise ValueError(f"vector width differs from {w}: pad the table first")
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return (flat if dtype is None else np.asarray(flat, dtype=dtype)).reshape(n, w)


def project(vectors, width: int, directions: np.ndarray) -> np.ndarray:
    """An Arrow column of vectors, dense or sparse, times the rows of ``directions``."""
    if pa.types.is_struct(vectors.type):
        sizes = vectors.field("size").to_numpy(zero_copy_only=False)
        if (sizes != width).any():
            raise ValueError(f"vector width differs from {width}")
        return sparse_product(vectors, directions)
    return arrow_matrix(vectors, width) @ directions.T


def _list_array(mat: np.ndarray) -> pa.Array:
    n, m = mat.shape
    offsets = pa.array(np.arange(0, n * m + 1, m, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.ravel().astype(np.int64)))


@dataclass(frozen=True)
class SignFamily:
    """Random-hyperplane (sign) LSH: ``n_tables`` tables of ``n_bits`` bits."""

    n_tables: int = DEFAULT_SIGN_TABLES
    n_bits: int = DEFAULT_SIGN_BITS
    seed: int = DEFAULT_SEED

    def __post_init__(self):
        if not 1 <= self.n_bits <= 62:
            raise ValueError("n_bits must be in 1..62 to pack a table into one long")
        if self.n_tables < 1:
            raise ValueError("n_tables must be >= 1")

    def planes(self, width: int) -> np.ndarray:
        """Gaussian planes, shape (n_tables, n_bits, width)."""
        _check_size(self.n_tables * self.n_bits * width)
        return np.stack([
            np.random.default_rng([self.seed, t]).standard_normal((self.n_bits, width))
            for t in range(self.n_tables)
        ])

    def directions(self, planes: np.ndarray) -> np.ndarray:
        """All planes of all tables, one per row."""
        return planes.reshape(self.n_tables * self.n_bits, -1)

    def signatures(self, x: np.ndarray, planes: np.ndarray | None = None) -> np.ndarray:
        """(n, width) vectors -> (n, n_tables) packed buckets."""
        p = self.planes(x.shape[1]) if planes is None else planes
        return self.buckets(x @ self.directions(p).T)

    def buckets(self, projected: np.ndarray) -> np.ndarray:
        """(n, n_tables * n_bits) projections -> (n, n_tables) packed buckets."""
        bits = (projected >= 0).reshape(len(projected), self.n_tables, self.n_bits)
        weights = np.left_shift(np.int64(1), np.arange(self.n_bits, dtype=np.int64))
        return (bits.astype(np.int64) * weights).sum(axis=2)


@dataclass(frozen=True)
class EuclideanFamily:
    """Bucketed random projection LSH: ``floor(a . v / bucket_length)`` per table."""

    bucket_length: float = DEFAULT_BUCKET_LENGTH
    n_tables: int = DEFAULT_EUCLID_TABLES
    seed: int = DEFAULT_SEED

    def __post_init__(self):
        if self.bucket_length <= 0:
            raise ValueError("bucket_length must be > 0")
        if self.n_tables < 1:
            raise ValueError("n_tables must be >= 1")

    def planes(self, width: int) -> np.ndarray:
        """Unit-length Gaussian directions, shape (n_tables, width)."""
        _check_size(self.n_tables * width)
        rows = [np.random.default_rng([self.seed, t]).standard_normal(width)
                for t in range(self.n_tables)]
        a = np.stack(rows)
        return a / np.linalg.norm(a, axis=1, keepdims=True)

    def directions(self, planes: np.ndarray) -> np.ndarray:
        return planes

    def signatures(self, x: np.ndarray, planes: np.ndarray | None = None) -> np.ndarray:
        a = self.planes(x.shape[1]) if planes is None else planes
        return self.buckets(x @ a.T)

    def buckets(self, projected: np.ndarray) -> np.ndarray:
        """(n, n_tables) projections -> (n, n_tables) buckets."""
        # Buckets beyond +-2^62 saturate, so huge values still hash the same way everywhere.
        buckets = np.nan_to_num(np.floor(projected / self.bucket_length))
        return np.clip(buckets, -(2.0 ** 62), 2.0 ** 62).astype(np.int64)


class SignPlanes:
    """Sign family with given planes, shape (n_tables, n_bits, width)."""

    def __init__(self, planes):
        self._planes = np.asarray(planes, dtype=np.float64)
        if self._planes.ndim != 3:
            raise ValueError("sign planes must have shape (n_tables, n_bits, width)")
        self.n_tables, self.n_bits, self.width = self._planes.shape

    def planes(self, width: int) -> np.ndarray:
        if width != self.width:
            raise ValueError(f"planes are {self.width} wide, vectors {width}")
        return self._planes

    directions = SignFamily.directions
    signatures = SignFamily.signatures
    buckets = SignFamily.buckets


class EuclideanPlanes:
    """Euclidean family with given directions, shape (n_tables, width), used as given."""

    def __init__(self, planes, bucket_length: float):
        self._planes = np.asarray(planes, dtype=np.float64)
        if self._planes.ndim != 2:
            raise ValueError("Euclidean planes must have shape (n_tables, width)")
        self.n_tables, self.width = self._planes.shape
        self.bucket_length = float(bucket_length)

    def planes(self, width: int) -> np.ndarray:
        if width != self.width:
            raise ValueError(f"planes are {self.width} wide, vectors {width}")
        return self._planes

    directions = EuclideanFamily.directions
    signatures = EuclideanFamily.signatures
    buckets = EuclideanFamily.buckets

    @classmethod
    def from_model(cls, model) -> "EuclideanPlanes":
        """The directions and bucket length of a fitted ``BucketedRandomProjectionLSHModel``.

        Lets pyspark's estimator serve as the backend that draws the planes; hashing and
        search then run here, with the same buckets as ``model.transform``.
        """
        vectors = model._java_obj.randUnitVectors()
        planes = np.array([list(v.toArray()) for v in vectors], dtype=np.float64)
        return cls(planes, model.getBucketLength())


def _check_size(values: int) -> None:
    if values > MAX_PLANE_VALUES:
        raise ValueError(f"hash family needs {values} plane values; lower tables, bits or width")


def signature_column(family, width: int, col="features") -> Column:
    """``array<bigint>``: one bucket per table, computed by an Arrow UDF per batch. The
    vectors are arrays or sparse vectors of ``width`` components."""
    planes = family.planes(width)

    @F.arrow_udf("array<bigint>")
    def _sig(v: pa.Array) -> pa.Array:
        projected = project(v, width, family.directions(planes))
        return _list_array(family.buckets(projected).reshape(len(v), family.n_tables))

    return _sig(F.col(col) if isinstance(col, str) else col)


def family_digest(family, width: int) -> str:
    """Name of what a family does to vectors of ``width`` components: equal digests, equal
    buckets. Indexes carry it, so that a search with another family is an error."""
    shape = (f"tables={family.n_tables} bits={getattr(family, 'n_bits', 0)} "
             f"length={getattr(family, 'bucket_length', 0.0)!r} width={width}")
    planes = np.ascontiguousarray(family.directions(family.planes(width)), dtype="<f8")
    return hashlib.sha256(shape.encode() + planes.tobytes()).hexdigest()


def check_family(df: DataFrame, sig: str, family, width: int) -> None:
    """Error if the stored signatures ``sig`` were made by another family."""
    made_by = df.schema[sig].metadata.get("family")
    if made_by is not None and made_by != family_digest(family, width):
        raise ValueError("the index was built with another hash family or vector width")


def projection_column(family, width: int, col="features") -> Column:
    """``array<double>``: the raw projections ``family.buckets`` is made of, one pass for
    every bucket length."""
    directions = family.directions(family.planes(width))

    @F.arrow_udf("array<double>")
    def _projected(v: pa.Array) -> pa.Array:
        p = project(v, width, directions)
        offsets = pa.array(np.arange(0, p.size + 1, max(1, p.shape[1]), dtype=np.int32)[:len(p) + 1])
        return pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))

    return _projected(F.col(col) if isinstance(col, str) else col)


def euclid_buckets(projected: Column, bucket_length: float) -> Column:
    """Buckets of stored projections, as ``EuclideanFamily.buckets`` gives them."""
    top = 1 << 62
    return F.transform(projected, lambda p: F.greatest(F.lit(-top), F.least(
        F.lit(top), F.floor(p / F.lit(float(bucket_length))).cast("long"))))


def hash_vectors(df: DataFrame, family, width: int, col: str = "features",
                 out: str = "sig") -> DataFrame:
    """Add the signature column ``out`` to a vector table."""
    return df.withColumn(out, signature_column(family, width, col))
