"""Embedding whitening: distributed covariance, float32 eigenvectors, mixed-precision refinement.

Components become integers, ``x = floor(scale * c) + shift``. The fit list holds every
distinct x vector once. Spark sums it per dimension; with the rounded mean taken off, the
entries are small integers y, whose products every task adds up exactly. Counts and sums of
y and y'y give the covariance (divisor n) as a fraction of whole numbers, rounded once: no
digits cancel, whatever the shift.

The driver holds the covariance alone, ``width`` squared numbers. Its eigenvectors are first
taken in float32 and then corrected by the iteration of Ogita and Aishima: from the residuals
R = I - X'X and S = X'AX, by matrix products in the widest float numpy offers, come eigenvalues
and a correction E of X (1 + E), which squares the error. Eigenvalues closer than the residual
allows to tell apart form a cluster: the matrix restricted to the cluster's vectors, with the
cluster's mean eigenvalue taken off, is solved on its own, in double precision relative to the
cluster's width, and its rotation applied; then the iteration goes on. Equal eigenvalues stay
a cluster and keep any orthonormal basis.

Whitened coordinates are projections of x less its mean on the components, over the root of
the eigenvalue. Components whose eigenvalue is not above ``RANK`` of the largest are left out:
they cannot be scaled to one.

Nulls and ties. Rows whose vector is null, or holds null or non-finite entries, are dropped.
Shorter vectors are padded with zero components. Rows with a repeated id, or a null id, are
rows of their own. Repeated vectors count once in the fit list, and every row gets its result.
Entries whose scaled size reaches 2^53 stop the job with an error. Further columns are never
read. An empty table, or one whose vectors are all equal, gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annspark.functions.hashing import arrow_matrix
from annspark.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
RANK = 1e-13
ROUNDS = 30
CHUNK = 4096
EXACT = 1 << 53
WIDE = np.longdouble  # 64 bits of mantissa where the machine has them, else double


def integer_vector(vec: Column, scale: int, shift: int, width: int) -> Column:
    """``floor(scale * c) + shift`` of every component, padded with zero components."""
    big = F.lit(float(EXACT))

    def whole(c):
        return (F.when(F.abs(c) * scale >= big, F.raise_error(F.lit("component too large for exact sums")))
                .otherwise(F.floor(c * F.lit(float(scale)))).cast("long") + F.lit(shift).cast("long"))

    return F.transform(F.concat(vec, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vec))), whole)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """``y'y`` in whole numbers: by float64 products while all sums stay below 2^53."""
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    top = int(np.abs(y).max(initial=0))
    step = CHUNK if top * top * CHUNK < EXACT else max(0, EXACT // max(1, top * top))
    if step == 0:
        y = y.astype(object)
        return y.T @ y
    for s in range(0, len(y), step):
        part = y[s:s + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(batches, width):
    """Of a task's rows: ``i = -1, j = -1`` the count, ``-1, j`` sums of entries."""
    n, total = 0, [0] * width
    for batch in batches:
        x = arrow_matrix(batch.column("x"), width, dtype=np.int64)
        n += len(x)
        top = int(np.abs(x).max(initial=0)) * max(1, len(x))
        part = x.sum(axis=0) if top < 1 << 62 else x.astype(object).sum(axis=0)
        total = [a + int(b) for a, b in zip(total, part)]
    if n:
        yield _triples([(-1, -1, n)] + [(-1, j, v) for j, v in enumerate(total)])


def _products(batches, width, middle):
    """Of a task's rows less ``middle``: sums of products of entries ``i <= j``."""
    total, any_rows = np.zeros((width, width), dtype=object), False
    middle = np.array(middle, dtype=np.int64)
    for batch in batches:
        any_rows = True
        total += _exact_products(arrow_matrix(batch.column("x"), width, dtype=np.int64) - middle)
    if any_rows:
        yield _triples([(i, j, int(total[i, j])) for i in range(width) for j in range(i, width)])


def _triples(rows) -> pa.RecordBatch:
    i, j, v = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(k) for k in v], pa.decimal128(38, 0))],
        names=["i", "j", "v"])


def _added(parts: DataFrame) -> dict:
    rows = parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    return {(r["i"], r["j"]): int(r["v"]) for r in rows}


class Fit:
    """Count, per-dimension sums and exact covariance of the fit list.

    At most ``width * (width + 1) / 2`` sums reach the driver."""

    def __init__(self, distinct: DataFrame, width: int):
        self.width = width
        triples = "i int, j int, v decimal(38,0)"
        first = _added(distinct.mapInArrow(lambda b: _sums(b, width), triples))
        self.n = first.get((-1, -1), 0)
        self.sums = [first.get((-1, j), 0) for j in range(width)]
        if self.n:
            n = self.n
            self.middle = [(2 * s + n) // (2 * n) for s in self.sums]
            self.rest = [s - n * m for s, m in zip(self.sums, self.middle)]  # sums of y
            middle = self.middle
            found = _added(distinct.mapInArrow(lambda b: _products(b, width, middle), triples))
            v = np.zeros((width, width), dtype=WIDE)
            for (i, j), total in found.items():
                v[i, j] = v[j, i] = _nearest(n * total - self.rest[i] * self.rest[j], n * n)
            self.covariance = v
            trace = sum(n * found[i, i] - self.rest[i] ** 2 for i in range(width))
            self.trace = _nearest(trace, n * n)
            self.offset = np.array([float(Fraction(r, n)) for r in self.rest])  # mean of y


def _nearest(over: int, under: int):
    """A fraction in the widest float: its double, and the double of what that leaves."""
    f = Fraction(over, under)
    high = float(f)
    return WIDE(high) + WIDE(float(f - Fraction(high)))


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that chains of steps of at most ``gap`` connect (two or more)."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cut) if len(part) > 1]


def correction(a: np.ndarray, x: np.ndarray):
    """One step of the iteration: eigenvalues, the correction E, and the gap below which
    eigenvalues cannot be told apart yet."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # so that E + E' is R, also among close eigenvalues
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    size = np.abs(a).sum(axis=1).max()
    gap = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return values, e, gap


def _sub_solve(a: np.ndarray, x: np.ndarray, at: np.ndarray, value) -> np.ndarray:
    """The cluster's vectors turned to the eigenvectors of the matrix restricted to them."""
    part = x[:, at]
    for _ in range(2):  # orthonormal to the last digit
        part = part + part @ ((np.eye(len(at), dtype=WIDE) - part.T @ part) / 2)
    inner = part.T @ (a @ part - value * part)
    size = np.abs(inner).max()
    if size == 0:
        return part
    turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))[1].astype(WIDE)
    turned = part @ turn
    return turned + turned @ ((np.eye(len(at), dtype=WIDE) - turned.T @ turned) / 2)


def refined_eigenvectors(a: np.ndarray, rounds: int = ROUNDS):
    """Eigenvalues, falling, and orthonormal eigenvectors (columns) of a symmetric matrix."""
    a = np.asarray(a, dtype=WIDE)
    size = np.abs(a).max(initial=0)
    if size == 0:
        return np.zeros(len(a), dtype=WIDE), np.eye(len(a), dtype=WIDE)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    unit = np.finfo(WIDE).eps * len(a)
    last = None
    for _ in range(rounds):
        values, e, gap = correction(a, x)
        x = x + x @ e
        moved = np.abs(e).max()
        if moved < unit or (moved < 1e-15 and last is not None and moved > last / 2):
            break
        last = moved
        values, _, gap = correction(a, x)
        for at in clusters(values, gap):
            if len(at) < len(a) or gap < 1:
                x[:, at] = _sub_solve(a, x, at, values[at].mean())
    x = x + x @ ((np.eye(len(a), dtype=WIDE) - x.T @ x) / 2)
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


def _whitened_sums(batches, width, middle, offset, project):
    """Of a task's rows: sums of the whitened coordinates and of their products."""
    k = project.shape[1]
    total, square, any_rows = np.zeros(k), np.zeros((k, k)), False
    for batch in batches:
        any_rows = True
        w = _coordinates(arrow_matrix(batch.column("x"), width, dtype=np.int64), middle, offset, project)
        total += w.sum(axis=0)
        square += w.T @ w
    if any_rows:
        flat = [(-1, j, v) for j, v in enumerate(total.tolist())]
        flat += [(i, j, v) for i, row in enumerate(square.tolist()) for j, v in enumerate(row)]
        i, j, v = zip(*flat)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)],
                                         names=["i", "j", "v"])


def _coordinates(x: np.ndarray, middle, offset, project) -> np.ndarray:
    return ((x - np.array(middle, dtype=np.int64)).astype(np.float64) - offset) @ project


def _deviation(x: np.ndarray, n: int, middle, rest) -> list:
    """Sums over the dimensions of ``(n * x - S) ** 2``, exact."""
    y = x - np.array(middle, dtype=np.int64)
    top = (int(np.abs(y).max(initial=0)) * n + max(map(abs, rest), default=0)) ** 2 * max(1, y.shape[1])
    kind = np.int64 if top < 1 << 62 else object
    away = y.astype(kind) * n - np.array(rest, dtype=kind)
    return [int(v) for v in (away * away).sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
           shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation (decimal), whitened, explained, identity_error``: a row
    per vector and component, components numbered from 1 by falling eigenvalue."""
    spark = vectors.sparkSession
    vec = F.col("vec")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
              .where("vec is not null").where(finite))
    width = usable.agg(F.max(F.size("vec"))).first()[0] or 0
    rows = written(usable.select("id", integer_vector(vec, scale, shift, width).alias("x")), "whitening-rows")
    distinct = written(rows.select("x").distinct(), "whitening-fit-list")
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    fit = Fit(distinct, width)
    if not fit.n:
        return spark.createDataFrame([], schema)
    values, x = refined_eigenvectors(fit.covariance)
    # A pinned sign: the largest entry of a component is positive.
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(width)] < 0, -1, 1)
    k = min(components, int((values > RANK * max(values.max(initial=0), WIDE(0))).sum()))
    if k == 0:
        return spark.createDataFrame([], schema)
    project = (x[:, :k] / np.sqrt(values[:k])).astype(np.float64)
    explained = [float(v) for v in values[:k] / fit.trace]
    n, middle, rest, offset = fit.n, fit.middle, fit.rest, fit.offset
    sums = distinct.mapInArrow(lambda b: _whitened_sums(b, width, middle, offset, project),
                               "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = {(r["i"], r["j"]): r["v"] for r in sums.collect()}  # k * (k + 1) numbers
    mean = np.array([found[-1, j] for j in range(k)]) / n
    square = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    error = float(np.abs(square - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, CHUNK):
                part = batch.slice(s, CHUNK)
                m = part.num_rows
                ints = arrow_matrix(part.column("x"), width, dtype=np.int64)
                w = _coordinates(ints, middle, offset, project)
                deviation = pa.array([Decimal(v) for v in _deviation(ints, n, middle, rest)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n, dtype=np.int64)), deviation.take(each), pa.array(w.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
