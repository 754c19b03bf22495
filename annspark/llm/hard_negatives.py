"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Vectors become integers, ``floor(scale * component)``, and a row's score is its integer
inner product with an anchor. An anchor's positives are the best rows of its own label; its
negatives, one list per positive, are the best rows of other labels whose score lies in
that positive's window, ``low`` to ``high`` percent of the positive's score.

Rows are cut into shards of bounded size. A shard's task sorts its rows once per dimension
and answers each of its anchors by the threshold algorithm: sorted access goes down the list
of a dimension where the anchor is positive, up where it is negative, and skips it where it
is zero; rows met for the first time are scored from their vectors (random access). The
values last met bound every row not met yet: that threshold is the anchor's product with
them. Access stops once the threshold is strictly below the kth score of every window, or
below a window's lower end, so equal scores are always met and ties go to the smaller id.
The depth doubles from step to step.

Positives are searched among the rows of the anchor's label: a label with more rows than a
shard is cut into several, small labels share one and are kept apart in the task. Negatives
are searched in shards dealt by a hash of the row, each against blocks of anchors that carry
their windows. A shard returns at most k rows per window, so what is merged per anchor is
bounded by the number of shards, and Spark cuts it to k before the exchange.

Nulls and ties. Rows with a null id, a null label, a null vector, or a null or non-finite
component take no part. Shorter vectors are padded with zeros, which leaves products alone.
Rows with a repeated id are rows of their own: each may be anchor, positive and negative,
and an anchor never meets itself; between equal scores and ids the order is that of the
stored rows. A component whose scaled size reaches 2^53 stops the job with an error, and so
does a score beyond a long. Further columns are never read. An empty table, or one without
anchors, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annspark.functions.hashing import arrow_matrix
from annspark.llm.common import attach, written
from annspark.operators.blocks import partitions_for

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SHARD_VALUES = 1 << 18  # integers of a shard: 4096 rows of 64 dimensions
START = 8
EXACT = 1 << 53

_FOUND = "a long, w int, id long, row long, score long, label string"


def integer_vector(vec: Column, scale: int, width: int) -> Column:
    """``floor(scale * c)`` of every component, padded with zeros to ``width``."""
    big = F.lit(float(EXACT))

    def whole(c):
        y = F.floor(F.lit(float(scale)) * c)
        return F.when(F.abs(c) * scale >= big, F.raise_error(F.lit("component too large for exact scores"))
                      ).otherwise(y).cast("long")

    padded = F.concat(vec, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vec)))
    return F.transform(padded, whole)


class Lists:
    """Rows of a shard with their order in every dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.largest = float(np.abs(x).max(initial=0))
        self.as_double = x.astype(np.float64)

    def arithmetic(self, anchor: np.ndarray):
        """Vectors, sorted values and anchor in a type that holds every score exactly."""
        if 128 * self.largest * float(np.abs(anchor).astype(np.float64).sum()) < EXACT:  # 100 x score too
            return self.as_double, self.sorted, anchor.astype(np.float64)
        return self.x.astype(object), self.sorted.astype(object), anchor.astype(object)

    def access(self, anchor: np.ndarray, done):
        """Rows and scores in the order of sorted access, until ``done(rows, scores,
        threshold)`` says so; it is asked after every step, first before any access."""
        x, values, a = self.arithmetic(anchor)
        n = len(x)
        down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        rows, scores = np.zeros(0, dtype=np.int64), a[:0]
        if not len(down) and not len(up):  # every score is zero
            return np.arange(n), x @ a
        seen = np.zeros(n, dtype=bool)
        depth, upto = 0, 0
        while True:
            at = max(depth, 1)
            threshold = (values[n - at, down] * a[down]).sum() + (values[at - 1, up] * a[up]).sum()
            if depth == n or len(rows) == n or done(rows, scores, threshold):
                return rows, scores
            upto = min(n, max(START, 2 * depth))
            met = np.zeros(n, dtype=bool)
            met[self.order[n - upto:n - depth, down]] = True
            met[self.order[depth:upto, up]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            rows = np.concatenate([rows, new])
            scores = np.concatenate([scores, x[new] @ a])
            depth = upto


def _best(rows, scores, ids, keys, k: int) -> np.ndarray:
    """Places of the k best in ``rows``: score, then smaller id, then stored order."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    order = np.lexsort((keys[rows[keep]], ids[rows[keep]], -scores[keep]))
    return keep[order[:k]]


def _kth(scores, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def _integers(column) -> np.ndarray:
    return arrow_matrix(column, dtype=np.int64)


def _emit(parts) -> pa.Table:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*parts) if parts else ([] for _ in names)
    return pa.table([pa.array([int(v) if not isinstance(v, str) else v for v in c], k)
                     for c, k in zip(columns, kinds)], names=names)


def positives_here(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Of each anchor the k best other rows of its label in this shard."""
    out = []
    if anchors.num_rows and rows.num_rows:
        x, ids, keys = _integers(rows["x"]), rows["id"].to_numpy(), rows["row"].to_numpy()
        of = np.array(rows["label"].to_pylist(), dtype=object)
        a, a_key = _integers(anchors["x"]), anchors["row"].to_numpy()
        a_of = np.array(anchors["label"].to_pylist(), dtype=object)
        for label in sorted(set(a_of)):
            members = np.flatnonzero(of == label)
            if not len(members):
                continue
            lists = Lists(x[members])
            m_ids, m_keys = ids[members], keys[members]
            for i in np.flatnonzero(a_of == label):
                def done(found, scores, threshold):
                    least = _kth(scores[m_keys[found] != a_key[i]], k)  # noqa: B023
                    return least is not None and threshold < least

                found, scores = lists.access(a[i], done)
                other = m_keys[found] != a_key[i]
                found, scores = found[other], scores[other]
                for p in _best(found, scores, m_ids, m_keys, k):
                    out.append((a_key[i], 0, m_ids[found[p]], m_keys[found[p]], scores[p], label))
    return _emit(out)


def negatives_here(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """Of each anchor and window the k best rows of other labels in this shard."""
    out = []
    if anchors.num_rows and rows.num_rows:
        lists = Lists(_integers(rows["x"]))
        ids, keys = rows["id"].to_numpy(), rows["row"].to_numpy()
        of = np.array(rows["label"].to_pylist(), dtype=object)
        a, a_key = _integers(anchors["x"]), anchors["row"].to_numpy()
        a_of, windows = anchors["label"].to_pylist(), anchors["windows"].to_pylist()
        differs = {label: of != label for label in set(a_of)}
        for i in range(len(a)):
            own, scores_of = differs[a_of[i]], windows[i]

            def inside(scores, p):
                return (low * p <= 100 * scores) & (100 * scores <= high * p)

            def done(found, scores, threshold):
                candidates = scores[own[found]]  # noqa: B023
                for p in scores_of:  # noqa: B023
                    if 100 * threshold < low * p:
                        continue
                    least = _kth(candidates[inside(candidates, p)], k)
                    if least is None or not threshold < least:
                        return False
                return True

            found, scores = lists.access(a[i], done)
            other = own[found]
            found, scores = found[other], scores[other]
            for w, p in enumerate(scores_of):
                at = np.flatnonzero(inside(scores, p))
                for b in _best(found[at], scores[at], ids, keys, k):
                    j = found[at[b]]
                    out.append((a_key[i], w, ids[j], keys[j], scores[at[b]], of[j]))
    return _emit(out)


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], kernel, parts: int) -> DataFrame:
    # New names for the anchors' columns: both sides come from the same stored rows.
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    return (anchors.repartition(parts, *keys).groupBy(*keys)
            .cogroup(rows.repartition(parts, *keys).groupBy(*keys))
            .applyInArrow(kernel, _FOUND))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _to_all(df: DataFrame, block: str, count: Column) -> DataFrame:
    return df.withColumn(block, F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   shard_values: int = SHARD_VALUES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the columns ``id`` and ``label``."""
    spark = vectors.sparkSession
    vec = F.col("vec")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                             F.col(vec_col).cast("array<double>").alias("vec"))
              .where("id is not null and label is not null and vec is not null").where(finite))
    facts = usable.agg(F.max(F.size("vec")), F.count(F.lit(1))).first()
    width, total = max(1, facts[0] or 1), facts[1]
    rows = written(usable.select("id", "label", integer_vector(vec, scale, width).alias("x"))
                   .withColumn("row", F.monotonically_increasing_id())
                   .withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "negatives-rows")
    size = max(64, shard_values // width)

    # Positives: shards hold one label each, or several small ones.
    labels = written(rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias("nb"),
        F.ceil(F.sum(F.col("anchor").cast("long")) / size).cast("int").alias("na")).where("na > 0"), "labels")
    placed = attach(rows, labels, "label", F.col("row")).where("na is not null")
    # Many more groups than shards' worth of rows: labels rarely meet, groups stay small.
    shared = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-16 * total // size))))
    group = F.when((F.col("nb") > 1) | (F.col("na") > 1), F.xxhash64("label")).otherwise(shared)
    placed = placed.withColumn("g", group)
    nb, na = F.col("nb"), F.col("na")
    held = _to_all(placed.withColumn("b", F.pmod(F.xxhash64("row"), nb).cast("int")), "ab", na)
    asking = _to_all(placed.where("anchor").withColumn("ab", F.pmod(F.xxhash64("row"), na).cast("int")), "b", nb)
    columns = ["g", "b", "ab", "row", "id", "label", "x"]
    parts = partitions_for(spark, total, width)
    best = _met(asking.select(*columns), held.select(*columns), columns[:3],
                lambda a, r: positives_here(a, r, positives), parts)
    chosen = written(_top(best, positives).select("a", "rank", "id", "score"), "positives")

    # Negatives: shards by a hash of the row, blocks of anchors with their windows.
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    lists = chosen.groupBy("a").agg(ordered.alias("p")).select(
        F.col("a").alias("row"), F.transform("p", lambda p: p["score"]).alias("windows"))
    anchors = written(rows.where("anchor").join(lists, "row"), "negatives-anchors")
    shards, blocks = max(1, -(-total // size)), max(1, -(-anchors.count() // size))
    asking = _to_all(anchors.withColumn("ab", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")),
                     "b", F.lit(shards))
    held = _to_all(rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")),
                   "ab", F.lit(blocks))
    found = _met(asking.select("b", "ab", "row", "id", "label", "x", "windows"),
                 held.select("b", "ab", "row", "id", "label", "x"), ["b", "ab"],
                 lambda a, r: negatives_here(a, r, negatives, low, high),
                 partitions_for(spark, total * blocks, width))
    hard = _top(found, negatives).select(
        "a", (F.col("w") + 1).alias("place"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    named = chosen.join(anchors.select(F.col("row").alias("a"), F.col("id").alias("anchor_id")), "a").select(
        "a", F.col("rank").alias("place"), "anchor_id", F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"))
    return hard.join(named, ["a", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")
