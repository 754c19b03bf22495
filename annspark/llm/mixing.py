"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

``target_s = min(weight_s * level, max_epochs * size_s)`` with one ``level`` for all
sources, such that the targets add up to the wanted total: sources that would pass their
cap are clamped to it and the excess goes to the others by weight, until none is above.
Each round is one map-side combined aggregate over the table of sources.

A source's repetitions ``target / size`` are a whole part, taken of every document, and a
fraction, taken of the documents that come first in a seeded order (MD5 of seed and id),
as long as they fit into the fraction of the source's size. What is still missing then is
less than the next document; it is filled by the one document left whose size comes
nearest to it, if that brings the words taken nearer to the target. Reruns agree.
Where one document is large, "less than the next document" may be most of the part. With
``refill`` (``mix``, and so the pipeline) the documents left that fit into what is missing
are taken in the same order, round by round, until none fits; the nearest one comes after.
``mix_table`` leaves it off: the SQL of ``op2_mixing`` has the nearest one only.

The seeded order needs running sums over a source, which may hold a third of all rows.
They are built in two levels: sizes per (source, leading digits of the MD5), running sums
over those 4096 digits, and running sums inside one digit group. Documents are joined and
sorted by (source, digits), so a hot source is spread over 4096 keys.

Nulls and ties. A null text has size 0; the null source is a source of its own, and so is
the empty one. A source of size 0 has target 0 and takes nothing. Documents with the same
id come in the order of their size. Sources without a weight (null or not above 0) take
nothing; if no weight is left, all targets are 0. If the caps add up to less than the
total, every weighted source ends at its cap. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annspark.llm.common import WORD, attach, columns_of, fresh, plain_key, text_key, written

MAX_EPOCHS = 3
SEED = 20
DIGITS = 3


def text_size(col: str = "text") -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: float | None = None) -> float | None:
    """The level of the targets; null where every cap stays below the total.

    ``sources``: ``weight double, cap double, source_size long``, one row per source; rows
    whose weight is null or not above 0 are left out."""
    sources = sources.where("weight > 0")
    if total is None:
        total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("held"),
                          F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
                          F.sum(above.cast("long")).alias("clamped")).first()
        if not row["open"]:
            return None
        if row["clamped"] == clamped:
            return level
        clamped = row["clamped"]
        level = (total - row["held"]) / row["open"]


def targets(sizes: DataFrame, weights: DataFrame | None, total_words: float | None = None,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from ``sizes`` (source, size per document)
    and ``weights`` (source, weight). Without weights they are 1, 2, 3, repeating over the
    sources in order, null last."""
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    if weights is None:
        # One row per source, not per document: the order of all sources is the feature.
        order = Window.orderBy(F.col("source").asc_nulls_last())
        found = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        found = totals.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    found = written(found.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double")),
                    "weights")
    if total_words is None:
        total_words = found.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(found, total_words)
    wanted = (F.col("cap") if level is None
              else F.least(F.col("weight") * F.lit(level), F.col("cap")))
    return found.select("source", "source_size", "weight",
                        F.when(F.col("weight") > 0, wanted).otherwise(0.0).alias("target"))


def _running(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``_sum``, the sizes of their source's earlier rows, on two levels."""
    rows = rows.withColumn("_digits", F.substring("_order", 1, DIGITS))
    earlier = Window.partitionBy("_key").orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    groups = (rows.groupBy("_key", "_digits").agg(F.sum("size").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    inside = (Window.partitionBy("_key", "_digits").orderBy("_order", "_place")
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.join(groups, ["_key", "_digits"])
    return (joined.withColumn("_sum", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("_before", "_digits"))


def _missing(rows: DataFrame) -> DataFrame:
    taken = F.sum(F.when(F.col("_fits"), F.col("size")).otherwise(0))
    return written(rows.groupBy("_key").agg((F.max("_part") - taken).alias("_missing")), "missing")


def _refilled(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_fits`` also set for left-over rows that fill what is missing. Each
    round takes at least one row of every source that still has one that fits."""
    missing, picked = _missing(rows), None
    spare = rows.where(~F.col("_fits") & (F.col("size") > 0)).select("_key", "_order", "_place", "size")
    while True:
        fitting = written(attach(spare, missing, "_key", F.xxhash64("_order"))
                          .where("size <= _missing"), "spare")
        if fitting.isEmpty():
            break
        tried = written(_running(fitting).withColumn("_took", F.col("_sum") + F.col("size") <= F.col("_missing")),
                        "tried")
        took = tried.where("_took").select("_key", "_order", "_place")
        picked = took if picked is None else picked.unionByName(took)
        missing = written(tried.groupBy("_key").agg(
            (F.max("_missing") - F.sum(F.when(F.col("_took"), F.col("size")).otherwise(0))).alias("_missing")),
            "missing")
        spare = tried.where(~F.col("_took")).select("_key", "_order", "_place", "size")
    if picked is None:
        return rows
    rows = rows.join(picked.withColumn("_more", F.lit(True)), ["_key", "_order", "_place"], "left")
    return written(rows.withColumn("_fits", F.col("_fits") | F.coalesce("_more", F.lit(False))).drop("_more"),
                   "refilled-rows")


def mix_counts(sizes: DataFrame, weights: DataFrame | None = None,
               total_words: float | None = None, max_epochs: int = MAX_EPOCHS,
               seed: int = SEED, refill: bool = False) -> DataFrame:
    """``sizes`` (``id, source, size`` and more columns) plus ``source_size, target`` and
    ``copies``, the number of times the mix takes the row."""
    goal = written(targets(sizes, weights, total_words, max_epochs), "targets")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = sizes.withColumn("_order", order).withColumn("_digits", F.substring("_order", 1, DIGITS))
    groups = keyed.groupBy("source", "_digits").agg(F.sum("size").alias("_n"))
    running = Window.partitionBy("source").orderBy("_digits")
    groups = groups.withColumn(
        "_before", F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, -1)))
    per = attach(groups, goal, "source", F.xxhash64("_digits"))
    per = per.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
                     "_digits", F.coalesce("_before", F.lit(0)).alias("_before"),
                     "source_size", "target")
    per = written(per, "digit-groups")
    rows = keyed.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    joined = rows.join(per, ["_key", "_digits"])
    inside = Window.partitionBy("_key", "_digits").orderBy("_order", "size")
    before = F.col("_before") + F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.col("target") - F.col("_whole") * F.col("source_size")
    rows = (joined.withColumn("_place", F.row_number().over(inside)).withColumn("_sum", before)
            .withColumn("_whole", whole.cast("long")).withColumn("_part", part)
            .withColumn("_fits", (F.col("size") > 0) & (F.col("_sum") + F.col("size") <= F.col("_part"))))
    rows = written(rows.drop("_before", "_digits", "_sum"), "mixed-rows")
    if refill:
        rows = _refilled(rows)
    missing = _missing(rows)
    off = F.abs(F.col("size") - F.col("_missing"))
    spare = attach(rows.where(~F.col("_fits") & (F.col("size") > 0)), missing, "_key", F.xxhash64("_order"))
    nearest = (spare.where(off < F.col("_missing")).groupBy("_key")
               .agg(F.min(F.struct(off.alias("off"), "_order", "_place")).alias("_pick"))
               .select("_key", F.col("_pick._order").alias("_pick_order"),
                       F.col("_pick._place").alias("_pick_place")))
    full = attach(rows, written(nearest, "nearest"), "_key", F.xxhash64("_order"))
    picked = F.coalesce((F.col("_order") == F.col("_pick_order"))
                        & (F.col("_place") == F.col("_pick_place")), F.lit(False))
    return (full.withColumn("copies", F.col("_whole") + (F.col("_fits") | picked).cast("long"))
            .drop("_order", "_place", "_whole", "_part", "_fits", "_pick_order", "_pick_place"))


def mix_table(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id",
              text_col: str = "text", source_col: str = "source", **opts) -> DataFrame:
    """``id, size, source, source_size, target, copies, taken`` per row of ``docs``."""
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                text_size(text_col).alias("size")), "sizes")
    mixed = mix_counts(sizes, weights, **opts)
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", **opts) -> DataFrame:
    """The mixed documents: the rows of ``docs``, all columns, each as many times as the
    mix takes it (rows it does not take are gone)."""
    sizes = written(docs.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("text_hash"),
        F.col(source_col).alias("source"), text_size(text_col).alias("size")), "sizes")
    mixed = mix_counts(sizes, weights, **{"refill": True, **opts})
    # Rows alike in id, text and source are interchangeable: their copies are added up and
    # dealt out again from one of them.
    *keys, n, each = fresh(docs, "_id", "_th", "_src", "_copies", "_n")
    same = [plain_key("id").alias(keys[0]), F.col("text_hash").alias(keys[1]), plain_key("source").alias(keys[2])]
    copies = mixed.where("copies > 0").groupBy(*same).agg(F.sum("copies").alias(n))
    copies = written(copies, "copies")
    keyed = docs.withColumns(dict(zip(keys, [plain_key(id_col), text_key(text_col), plain_key(source_col)])))
    # The grouping is the join's own partitioning and order: texts are shuffled once.
    one = keyed.join(copies, keys).dropDuplicates(keys)
    return (one.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
            .select(*columns_of(docs)))
