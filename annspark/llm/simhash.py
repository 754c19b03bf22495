"""SimHash near-duplicates: vantage-point tree shards, exact pairs within a few bits.

1. Every text gets a 64-bit SimHash of its word shingles (one Arrow pass).
2. Equal fingerprints become one class; only distinct fingerprints go on.
3. A vantage-point tree is built from a bounded sample of them (``sample_rows``, a
   documented bound): each node has a vantage fingerprint ``v`` and a radius ``mu`` and
   splits into ``d(v, x) <= mu`` and ``d(v, x) > mu``. Every fingerprint falls to exactly
   one shard, its own. The triangle inequality bounds the rest: two fingerprints within
   ``r`` bits have distances to ``v`` that differ by at most ``r``, so a row visits the
   other side only when its ball of radius ``r`` crosses ``mu``. A pair parted at a node
   is found from its inner member, so outer rows need not visit back.
4. Per shard a task compares its own rows with its visitors (xor and bit count) and
   emits a spanning forest of the links: at most one link a row, however dense the shard.
   Shards with more than ``block_rows`` rows are cut into a grid of blocks, so that no
   task holds more than two blocks.
5. Components of the forest links are components of all links.

Nulls and ties. A null or empty text, and a text without words, has fingerprint zero and
is linked like any other. Rows are never merged by id: each row gets a result row, also
when ids repeat. The component id is the smallest non-null id of the component (null when
all ids in it are null). Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annspark.llm.common import columns_of, fresh, plain_key, text_key, written
from annspark.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
SAMPLE_ROWS = 16_384
SHARD_ROWS = 2_048
BLOCK_ROWS = 16_384
CHUNK = 2_000_000


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words of the ASCII-lower-cased text."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z and the six ASCII spaces.
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) < words:
        runs = [b" ".join(w)]
    else:
        runs = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, HASH_SEED) for x in runs), dtype=np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash: bit b is set if it is set in more than half of the shingle hashes."""
    h = shingle_hashes(text, words)
    counts = np.zeros(64, dtype=np.int64)
    for s in range(0, len(h), 65_536):
        part = h[s:s + 65_536].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, text_hash, fp``: one row per row of ``docs``."""

    @F.arrow_udf("long")
    def _fp(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())

    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_hash"),
                       _fp(F.col(text_col)).alias("fp"))


@dataclass
class Tree:
    """Vantage-point tree; child numbers below zero are shards (``-1 - shard``)."""

    vantage: list
    mu: list
    inner: list
    outer: list
    shards: int

    def visits(self, fp: np.ndarray, radius: int):
        """``(shard, rows, own)`` for all shards that rows of ``fp`` fall in or visit."""
        stack = [(0 if self.vantage else -1, np.arange(len(fp)), np.ones(len(fp), dtype=bool))]
        while stack:
            node, rows, own = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows, own
                continue
            d = np.bitwise_count(fp[rows] ^ self.vantage[node]).astype(np.int64)
            mu = self.mu[node]
            inside = d <= mu
            # Own rows stay own on their side; inner rows whose ball crosses mu visit the
            # outer side. Visitors go wherever their ball reaches.
            to_in = np.where(own, inside, d - radius <= mu)
            to_out = d + radius > mu
            stack.append((self.inner[node], rows[to_in], own[to_in]))
            stack.append((self.outer[node], rows[to_out], (own & ~inside)[to_out]))


def build_tree(sample: np.ndarray, leaf_rows: int, radius: int, seed: int = 7) -> Tree:
    """Tree over a sample; a node becomes a shard at ``leaf_rows`` sample rows, or when no
    vantage splits it without most rows visiting both sides."""
    rng = np.random.default_rng(seed)
    tree = Tree([], [], [], [], 0)

    def grow(rows: np.ndarray) -> int:
        best = None
        if len(rows) > leaf_rows:
            for v in sample[rng.choice(rows, size=min(8, len(rows)), replace=False)]:
                d = np.bitwise_count(sample[rows] ^ v).astype(np.int64)
                n = np.bincount(d, minlength=65)
                inside = np.cumsum(n) / len(rows)
                for mu in range(64):
                    share = min(inside[mu], 1 - inside[mu])
                    crossing = n[max(0, mu - radius + 1):mu + radius + 1].sum() / len(rows)
                    if share >= 0.2 and crossing < 0.7:
                        cost = crossing - share
                        if best is None or cost < best[0]:
                            best = (cost, v, mu, d <= mu)
        if best is None:
            tree.shards += 1
            return -tree.shards
        _, v, mu, inside = best
        node = len(tree.vantage)
        tree.vantage.append(v)
        tree.mu.append(mu)
        tree.inner.append(0)
        tree.outer.append(0)
        tree.inner[node] = grow(rows[inside])
        tree.outer[node] = grow(rows[~inside])
        return node

    grow(np.arange(len(sample)))
    return tree


def union_pairs(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (a member's smallest known fellow) after joining the pairs (i, j)."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def forest(keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links (at most ``radius`` differing bits) among distinct
    ``keys``: pairs (member, smallest member of its component)."""
    n = len(keys)
    label = np.arange(n)
    step = max(1, CHUNK // max(1, n))
    for s in range(0, n, step):
        near = np.bitwise_count(keys[s:s + step, None] ^ keys[None, s:]) <= radius
        i, j = np.divmod(np.flatnonzero(near), n - s)
        i, j = i + s, j + s
        label = union_pairs(label, i, j)
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def links(classes: DataFrame, radius: int = MAX_BITS, sample_rows: int = SAMPLE_ROWS,
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: forest links among the distinct fingerprints ``fp`` of ``classes``."""
    spark = classes.sparkSession
    total = classes.count()
    # A hash-chosen sample: at most a sixteenth of the fingerprints, about sample_rows.
    cut = int((1 << 30) * min(1 / 16, sample_rows / max(1, total)))
    picked = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < cut).select("fp")
    sample = np.array(sorted(r[0] for r in picked.collect()), dtype=np.int64).view(np.uint64)
    share = len(sample) / max(1, total)
    tree = build_tree(sample, max(16, int(shard_rows * share)), radius)

    def count(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            out = [(shard, int(own.sum()), len(own)) for shard, _, own in tree.visits(fp, radius)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], pa.int64()) for k in range(3)],
                names=["shard", "own", "rows"])

    # One row per shard; the tree, and so this table, is bounded by the sample.
    sizes = (classes.select("fp").mapInArrow(count, "shard long, own long, rows long")
             .groupBy("shard").agg(F.sum("own").alias("own"), F.sum("rows").alias("rows")).collect())
    grid = {r["shard"]: (max(1, math.ceil(r["own"] / block_rows)),
                         max(1, math.ceil(r["rows"] / block_rows))) for r in sizes}

    def place(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            parts = []
            for shard, rows, own in tree.visits(fp, radius):
                bl, br = grid[shard]
                x = fp[rows]
                mixed = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                lb = ((mixed >> np.uint64(33)) % np.uint64(bl)).astype(np.int64)
                rb = ((mixed >> np.uint64(20)) % np.uint64(br)).astype(np.int64)
                for left in range(bl):  # as right side: to every left block
                    parts.append((np.full(len(x), shard), np.full(len(x), left), rb, x))
                for right in range(br):  # as left side: to every other right block
                    more = own & (rb != right)
                    parts.append((np.full(more.sum(), shard), lb[more],
                                  np.full(more.sum(), right), x[more]))
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64), pa.int64()) for c in cols[:3]]
                + [_signed(cols[3].astype(np.uint64))], names=["shard", "lb", "rb", "fp"])

    def join(table: pa.Table) -> pa.Table:
        signed = np.unique(table.column("fp").to_numpy())
        member, root = forest(signed.view(np.uint64), radius)
        return pa.table({"a": signed[root], "b": signed[member]})

    tasks = sum(bl * br for bl, br in grid.values())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tasks / 64))
    return (classes.select("fp").mapInArrow(place, "shard long, lb long, rb long, fp long")
            .repartition(n, "shard", "lb", "rb").groupBy("shard", "lb", "rb")
            .applyInArrow(join, "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **opts) -> DataFrame:
    """``id, text_hash, fp, class_size, component_id, keep`` per row of ``docs``.

    ``component_id`` is the smallest id reachable by links; ``keep`` holds for exactly the
    rows of one (id, text) per component: its smallest id, then smallest text hash."""
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("class_size"),
                                            F.min("id").alias("least_id")), "classes")
    roots = components(links(classes, max_bits, **opts))
    of = (classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
          .withColumn("root", F.coalesce("root", "fp")))
    of = written(of, "class-roots")
    least = written(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    of = written(of.join(least, "root"), "class-components")
    rows = written(fps.join(of.drop("least_id"), "fp"), "rows")
    # The survivor of a component: its least id, and of rows sharing it the least text hash.
    chosen = (rows.where(F.col("id").eqNullSafe(F.col("component_id")))
              .groupBy("root").agg(F.min("text_hash").alias("kept_hash")))
    return (rows.join(written(chosen, "chosen"), "root")
            .withColumn("keep", F.col("id").eqNullSafe(F.col("component_id"))
                        & (F.col("text_hash") == F.col("kept_hash")))
            .select("id", "text_hash", "fp", "class_size", "component_id", "keep"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **opts) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one document of each component."""
    found = simhash_components(docs, id_col, text_col, words, max_bits, **opts)
    key = fresh(docs, "_id", "_th")
    kept = written(found.where("keep").select(plain_key("id").alias(key[0]),
                                              F.col("text_hash").alias(key[1])).distinct(), "kept")
    keyed = docs.withColumns({key[0]: plain_key(id_col), key[1]: text_key(text_col)})
    # Repeated rows share id and text: one of them stays. The grouping is the join's own
    # partitioning and order, so texts are shuffled once.
    one = keyed.join(kept, key, "left_semi").dropDuplicates(key)
    return one.select(*columns_of(docs))
