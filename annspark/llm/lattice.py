"""Embedding near-duplicates by lattice hashing: E8 cells, neighbouring cells, exact cosine.

Every table projects the unit vectors to eight dimensions with seeded Gaussian directions,
scales and shifts them, and decodes the nearest point of the lattice E8; the lattice point
names the vector's cell. Near vectors fall into the same cell or a neighbouring one, so each
vector also visits the ``probes`` neighbouring lattice points nearest to its projection
(among the 240 shortest lattice vectors around its own point).

Only cells with an owner and another row get vectors: that is decided on ids alone. A
cell's task compares its own vectors with one another and with its visitors. A pair that
passes a float32 product is decided by its cosine in double precision. A pair may meet in
several cells; from both vectors' cells and probes each task knows the first meeting of a
pair (tables in order, then the smaller cell), and only that one counts it. So link counts
are exact sums and no pair leaves a task: out come one count per vector and task, and a
spanning forest of the links.

Equal vectors form one class with a multiplicity before anything is compared. Classes in
the same cell beyond ``block_rows`` are cut into blocks, and the blocks of a cell meet in a
grid, so that a cell that holds a third of all vectors is spread over many bounded tasks.

Nulls and ties. Vectors that are null, empty, zero, or hold null, NaN or infinite
components link with nothing: no links, their own component. Vectors of another width than
``width`` (the widest of the usable ones) are padded with zeros, which leaves cosines
alone. Rows with a repeated id get a row each; they stand for separate vectors, and share
links like others. A null id is never a component id unless all ids of the component are
null. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annspark.llm.common import written
from annspark.llm.components import components
from annspark.llm.simhash import union_pairs

COSINE = 0.95
TABLES = 5
PROBES = 4
SCALE = 0.8
SEED = 8
BLOCK_ROWS = 1024
CHUNK = 1_000_000


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of size 1, or all of size 1/2 with an
    even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1.0 - 2.0 * (bits >> k & 1) for k in range(8)])
        if signs.prod() > 0:
            out.append(signs / 2)
    return np.array(out)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum): rounding, and where the sum is
    odd the entry rounded worst goes the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    off = x[odd] - r[odd]
    k = np.abs(off).argmax(axis=1)
    r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``x``: the better one of D8 and D8 + 1/2."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cell_ids(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit names of lattice points of a table (doubled coordinates, mixed)."""
    h = np.full(points.shape[:-1], np.uint64(0x9E3779B97F4A7C15 * (table + 1) % (1 << 64)))
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for k in range(8):
        h = (h ^ doubled[..., k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Lattice:
    def __init__(self, width: int, tables: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((tables, width, 8)) * scale
        self.shifts = rng.random((tables, 8)) * 2
        self.around = shortest_vectors()
        self.probes = probes

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """``(rows, tables, 1 + probes)``: own cell first, then the visited ones."""
        out = np.empty((len(unit), len(self.directions), 1 + self.probes), dtype=np.int64)
        for t, (a, shift) in enumerate(zip(self.directions, self.shifts)):
            x = unit @ a + shift
            own = decode(x)
            out[:, t, 0] = cell_ids(own, t)
            # |x - own - v|^2 over the neighbours v, up to a constant: |v|^2 is 2 for all.
            reach = (x - own) @ self.around.T
            best = np.argpartition(-reach, self.probes - 1, axis=1)[:, :self.probes] \
                if self.probes else np.zeros((len(x), 0), dtype=np.int64)
            out[:, t, 1:] = cell_ids(own[:, None, :] + self.around[best], t)
        return out


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) if n else np.zeros((0, 1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def first_here(t, here, own_i, own_j, visits_i, visits_j) -> np.ndarray:
    """Whether cell ``here`` of table ``t`` is the first place where the pairs meet.

    ``own`` are cells by table, ``visits`` own and probed cells by table, row by row."""
    first = np.ones(len(own_i), dtype=bool)
    for k in range(t + 1):
        i_at_j = (visits_i[:, k] == own_j[:, k, None]).any(axis=1)
        j_at_i = (visits_j[:, k] == own_i[:, k, None]).any(axis=1)
        if k < t:
            first &= ~(i_at_j | j_at_i)
        else:  # they may meet at i's cell and at j's cell: the smaller one counts
            at = np.where(i_at_j & j_at_i, np.minimum(own_i[:, t], own_j[:, t]),
                          np.where(i_at_j, own_j[:, t], own_i[:, t]))
            first &= at == here
    return first


def compare(table: pa.Table, cosine: float, tables: int, probes: int) -> pa.Table:
    """One block pair of a cell: link counts per vector and a forest of the links."""
    t, here = table.column("tbl")[0].as_py(), table.column("cell")[0].as_py()
    left = np.flatnonzero(table.column("as_left").to_numpy(zero_copy_only=False))
    right = np.arange(table.num_rows)
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    own_here = table.column("own").to_numpy(zero_copy_only=False)
    cells = _matrix(table.column("cells")).reshape(-1, tables, 1 + probes)
    own = cells[:, :, 0]
    unit = unit_rows(_matrix(table.column("vec")))
    unit32 = unit.astype(np.float32)
    as_right = table.column("as_right").to_numpy(zero_copy_only=False)
    right = right[as_right]
    count = np.zeros(len(key), dtype=np.int64)
    label = np.arange(len(key))
    step = max(1, CHUNK // max(1, len(right)))
    for s in range(0, len(left), step):
        rows = left[s:s + step]
        near = unit32[rows] @ unit32[right].T >= cosine - 1e-4
        i, j = np.divmod(np.flatnonzero(near), len(right))
        i, j = rows[i], right[j]
        # Two owners of the cell are compared once, the owner of the smaller key on the left.
        ok = np.where(own_here[j], key[i] < key[j], True) & (key[i] != key[j])
        i, j = i[ok], j[ok]
        for c in range(0, len(i), CHUNK):
            a, b = i[c:c + CHUNK], j[c:c + CHUNK]
            ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            a, b = a[ok], b[ok]
            ok = first_here(t, here, own[a], own[b], cells[a], cells[b])
            a, b = a[ok], b[ok]
            np.add.at(count, a, n[b])
            np.add.at(count, b, n[a])
            label = union_pairs(label, a, b)
    keep = (count > 0) | (label != np.arange(len(key)))
    return pa.table({"key": key[keep], "links": count[keep], "to": key[label[keep]]})


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES,
                 scale: float = SCALE, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, n_links, component_id, kept`` per row of ``vectors``."""
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    usable = (F.col(vec_col).isNotNull() & (F.size(vec) > 0)
              & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists(vec, lambda x: x != 0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"),
                          F.coalesce(usable, F.lit(False)).alias("usable"))
    width = rows.where("usable").agg(F.max(F.size("vec"))).first()[0] or 1
    zero = F.lit(0).cast(vectors.schema[vec_col].dataType.elementType)
    padded = F.concat("vec", F.array_repeat(zero, F.lit(width) - F.size("vec")))
    # -0.0 and 0.0 are one value, so that equal vectors are equal bytes.
    clean = F.transform(padded, lambda x: F.when(x == 0, zero).otherwise(x))
    rows = rows.withColumn("vec", F.when(F.col("usable"), clean))
    keyed = written(rows.select("id", "usable", "vec"), "vectors")
    classes = written(
        keyed.where("usable").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"))
        .select("vec", "n", "least_id", F.monotonically_increasing_id().alias("key")), "vector-classes")
    lattice = Lattice(width, tables, probes, scale, seed)

    per = tables * (1 + probes)

    def sign(batches):
        for batch in batches:
            cells = lattice.cells(unit_rows(_matrix(batch.column("vec"))))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(cells) * per + 1, per, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n"), batch.column("vec"), lists],
                names=["key", "n", "vec", "cells"])

    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    signed = written(classes.select("key", "n", "vec").mapInArrow(
        sign, f"key long, n long, vec array<{kind}>, cells array<long>"), "cells")
    # Ids only until it is known which cells hold a pair: an owner and another row.
    flat = signed.select("key", F.posexplode("cells").alias("pos", "cell")).select(
        "key", "cell", F.floor(F.col("pos") / (1 + probes)).cast("int").alias("tbl"),
        (F.col("pos") % (1 + probes) == 0).alias("own"))
    live = (flat.groupBy("cell").agg(F.sum(F.col("own").cast("long")).alias("owners"),
                                     F.count(F.lit(1)).alias("rows"))
            .where("owners > 0 and rows > 1")
            .select("cell", F.ceil(F.col("owners") / block_rows).cast("int").alias("bl"),
                    F.ceil(F.col("rows") / block_rows).cast("int").alias("br")))
    placed = flat.join(written(live, "live-cells"), "cell")
    lb = F.pmod(F.xxhash64("key", F.lit(1)), F.col("bl")).cast("int")
    rb = F.pmod(F.xxhash64("key", F.lit(2)), F.col("br")).cast("int")
    # As right side a row goes to every left block, an owner as left side to every right block.
    grid = F.transform(F.sequence(F.lit(0), F.col("bl") - 1), lambda x: F.struct(
        x.alias("l"), F.col("rb").alias("r"), (F.col("own") & (x == F.col("lb"))).alias("as_left"),
        F.lit(True).alias("as_right")))
    more = F.transform(F.sequence(F.lit(0), F.col("br") - 1), lambda y: F.struct(
        F.col("lb").alias("l"), y.alias("r"), F.lit(True).alias("as_left"), F.lit(False).alias("as_right")))
    more = F.when(F.col("own"), F.filter(more, lambda z: z["r"] != F.col("rb"))).otherwise(F.slice(more, 1, 0))
    dealt = (placed.withColumn("lb", lb).withColumn("rb", rb)
             .withColumn("at", F.explode(F.concat(grid, more)))
             .select("key", "tbl", "cell", "own", "at.*").join(signed, "key"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64)
    met = (dealt.repartition(parts, "cell", "l", "r").groupBy("cell", "l", "r")
           .applyInArrow(lambda t: compare(t, cosine, tables, probes), "key long, links long, to long"))
    met = written(met, "links-found")
    counts = met.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("key").alias("a"), F.col("to").alias("b")))
    of = (classes.select("vec", "n", "least_id", "key").join(counts, "key", "left")
          .join(roots.withColumnRenamed("node", "key"), "key", "left")
          .withColumn("root", F.coalesce("root", "key")))
    of = written(of, "vector-roots")
    least = written(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    of = written(of.join(least, "root").select(
        "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "found")
    out = keyed.join(of, "vec", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
