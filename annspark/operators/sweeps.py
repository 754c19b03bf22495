"""Parameter sweeps (H7): every setting from one hashing and one pass over the blocks.

Each vector is projected once, on the directions of the widest setting. The buckets of a
bucket length are floors of the stored projections; those of fewer sign bits are the low
bits of the stored signature. Such a derivation is a *variant*.

A pair of rows is met at the first table of a variant where the two share a bucket, so the
rows a block emits belong to every setting of that variant with more tables than that one:
all numbers of tables come out of the widest one's blocks, tagged with variant and table.
The top of the largest k is kept per setting and query, and every smaller k is scored from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annspark.functions.hashing import (
    DEFAULT_SEED,
    EuclideanFamily,
    SignFamily,
    euclid_buckets,
    projection_column,
    signature_column,
)
from annspark.functions.vectors import search_width
from annspark.operators.blocks import (
    DEFAULT_BLOCK_ROWS,
    DEFAULT_MAX_BROADCAST_ROWS,
    BlockKernel,
    block_size,
    count_rows,
    lsh_blocks,
    partitions_for,
    run_blocks,
    with_queries_only,
)
from annspark.operators.classify import no_prediction, same_label
from annspark.operators.search import _row_size, _sides, exact_knn
from annspark.operators.topk import merge_top_k
from annspark.session import checkpoint_dir, scratch_path

# The reference's search grid (bucket length x tables x k), and the sign
# settings (bits, tables) of its launch script.
SEARCH_BUCKET_LENGTHS = (2.0, 5.0, 8.0)
SEARCH_TABLES = (3, 5, 7)
SEARCH_KS = (1, 5, 9)
SIGN_SETTINGS = ((3, 10), (5, 20), (7, 25), (5, 10))


@dataclass(frozen=True)
class Variant:
    """Buckets derived from the stored column, and the numbers of tables to score."""

    buckets: object  # Column -> Column: array<bigint>, one bucket per table
    tables: tuple[int, ...]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exploded(df: DataFrame, variants: list[Variant], side: str) -> DataFrame:
    """A row per variant and table, with the buckets of the earlier tables."""
    each = [F.struct(F.lit(v).alias("variant"), F.slice(var.buckets(F.col("base")), 1, max(var.tables)).alias("sig"))
            for v, var in enumerate(variants)]
    rest = [c for c in df.columns if c != "base"]
    return (df.select(*rest, F.explode(F.array(*each)).alias("v"))
            .select(*rest, "v.*")
            .select(*rest, "variant", "sig", F.posexplode_outer("sig").alias("tbl", "bucket"))
            .withColumn("sig", F.slice("sig", 1, F.col("tbl"))).withColumnRenamed("sig", f"{side}_sig"))


def tagged_search(query: DataFrame, train: DataFrame, base, variants: list[Variant], k: int,
                  threshold: float | None = None, exclude_self: bool = False, id_col: str = "id",
                  features: str = "features", label: str = "label", width: int | None = None,
                  counts: tuple[int, int] | None = None, block_rows: int = DEFAULT_BLOCK_ROWS,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """The k nearest candidates of every query under every setting: ``setting, q_id, t_id,
    t_label, distance, rn, n_candidates``. ``base(vector column, width)`` is the column
    stored once per row; settings number the variants' tables in order."""
    spark = query.sparkSession
    q, t = _sides(query, train, id_col, features, label)
    w = width or search_width(train, query, col=features)
    n_q, n_t = counts or count_rows(query.select(id_col), train.select(id_col))
    q = _stored(q.withColumn("base", base("q_vec", w)), "sweep-queries")
    t = _stored(t.withColumn("base", base("t_vec", w)), "sweep-rows")
    q_exp, t_exp = _exploded(q, variants, "q"), _exploded(t, variants, "t")
    table = ("variant", "tbl")
    n_tables = sum(max(v.tables) for v in variants)
    t_exp = with_queries_only(t_exp, q_exp, n_tables, max_broadcast_rows, table)
    values, value_bytes = _row_size(train, features, w)
    rows = block_size(block_rows, max(n_q, n_t), values * value_bytes)
    q_side, t_side, added = lsh_blocks(q_exp, t_exp, rows, max_broadcast_rows, n_q, n_t, table)
    n_tasks = partitions_for(spark, (n_q + n_t) * n_tables + added, values, value_bytes)
    raw = run_blocks(q_side, t_side, [*table, "bgroup", "tblock", "qblock"],
                     BlockKernel(k, threshold, exclude_self, first_table=True), n_tasks, carry=table)
    settings = [(v, n) for v, var in enumerate(variants) for n in var.tables]
    all_settings = F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(v).alias("v"), F.lit(n).alias("n"))
                             for s, (v, n) in enumerate(settings)])
    mine = F.filter(all_settings, lambda s: (s["v"] == F.col("variant")) & (s["n"] > F.col("tbl")))
    raw = raw.withColumn("setting", F.explode(F.transform(mine, lambda s: s["setting"])))
    return merge_top_k(raw.drop(*table), k, n_tasks, by=("setting", "q_id"))


def _scored(query: DataFrame, train: DataFrame, base, variants: list[Variant], names: list[dict], ks,
            threshold, id_col: str, label: str, truth: DataFrame | None, opts: dict) -> DataFrame:
    """``names`` (columns of a setting) plus ``k, accuracy, recall, n_candidates``."""
    ks = sorted({int(k) for k in ks})
    features = opts.get("features", "features")
    checkpoint_dir(query.sparkSession)
    # Facts shared by the searches: one job each.
    opts.setdefault("width", search_width(train, query, col=features))
    opts.setdefault("counts", count_rows(query.select(id_col), train.select(id_col)))
    if truth is None:
        truth = exact_knn(query, train, ks[-1], id_col=id_col, label=label, **opts)
    truth = (truth.where(F.col("rn") <= ks[-1])
             .select("q_id", "t_id", F.col("rn").alias("true_rn")).checkpoint(eager=True))
    nb = tagged_search(query, train, base, variants, ks[-1], threshold, id_col=id_col, label=label, **opts)
    every_k = F.array(*[F.lit(k) for k in ks])
    # A neighbour at rank rn goes to every k >= rn; it is a hit where it is also in the true top k.
    met = nb.join(truth, ["q_id", "t_id"], "left")
    met = (met.withColumn("k", F.explode(F.filter(every_k, lambda k: k >= F.col("rn"))))
           .withColumn("hit", F.coalesce((F.col("true_rn") <= F.col("k")).cast("int"), F.lit(0))))
    voted = _vote(met)
    asked = (query.select(F.col(id_col).cast("long").alias("q_id"), F.col(label).alias("label"))
             .withColumn("setting", F.explode(F.array(*[F.lit(s) for s in range(len(names))])))
             .withColumn("k", F.explode(every_k)))
    kind = voted.schema["prediction"].dataType
    all_q = asked.join(voted, ["setting", "k", "q_id"], "left").withColumn(
        "prediction", F.coalesce("prediction", no_prediction(kind)))
    scored = all_q.groupBy("setting", "k").agg(
        F.avg(F.coalesce(same_label(all_q, "label", "prediction"), F.lit(False)).cast("double")).alias("accuracy"),
        (F.coalesce(F.sum("hits"), F.lit(0)) / (F.col("k") * F.count(F.lit(1)))).alias("recall"),
        F.coalesce(F.sum("n_cand"), F.lit(0)).cast("long").alias("n_candidates"))
    kinds = ", ".join(f"{c} {'double' if isinstance(v, float) else 'int'}" for c, v in names[0].items())
    table = query.sparkSession.createDataFrame([(s, *n.values()) for s, n in enumerate(names)], f"setting int, {kinds}")
    return scored.join(F.broadcast(table), "setting").select(
        *names[0], "k", "accuracy", "recall", "n_candidates")


def _vote(met: DataFrame) -> DataFrame:
    """The vote of ``classify.vote`` per setting and k, with the hits counted along."""
    by = ["setting", "k", "q_id"]
    per_label = met.groupBy(*by, "t_label").agg(
        F.count(F.lit(1)).alias("votes"), F.min("distance").alias("nearest"),
        F.max("n_candidates").alias("n_cand"), F.sum("hit").alias("h"))
    window = Window.partitionBy(*by)
    order = window.orderBy(F.desc("votes"), "nearest", "t_label")
    return (per_label.withColumn("hits", F.sum("h").over(window)).withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") == 1).select(*by, F.col("t_label").alias("prediction"), "n_cand", "hits"))


def sweep(query: DataFrame, train: DataFrame, bucket_lengths=SEARCH_BUCKET_LENGTHS,
          n_tables_list=SEARCH_TABLES, ks=SEARCH_KS, threshold: float | None = None,
          seed: int = DEFAULT_SEED, id_col: str = "id", label: str = "label",
          truth: DataFrame | None = None, **opts) -> DataFrame:
    """Grid over bucket length x tables x k: ``bl, nht, k, accuracy, recall, n_candidates``.

    ``truth`` (long rows ``q_id, t_id, rn``, e.g. ``truth_from_lists`` of a ground-truth
    file) replaces the exact search for the recall, which is quadratic."""
    tables = tuple(sorted({int(n) for n in n_tables_list}))
    lengths = [float(b) for b in bucket_lengths]
    widest = EuclideanFamily(lengths[0], tables[-1], seed)

    def floors(length: float):
        return lambda base: euclid_buckets(base, length)

    variants = [Variant(floors(b), tables) for b in lengths]
    names = [{"bl": b, "nht": n} for b in lengths for n in tables]
    return _scored(query, train, lambda col, w: projection_column(widest, w, col), variants, names, ks,
                   threshold, id_col, label, truth, opts)


def sweep_sign(query: DataFrame, train: DataFrame, settings=SIGN_SETTINGS, ks=SEARCH_KS,
               threshold: float | None = None, seed: int = DEFAULT_SEED, id_col: str = "id",
               label: str = "label", truth: DataFrame | None = None, **opts) -> DataFrame:
    """Sign family over settings (bits, tables) x k: ``bits, tables, k, accuracy, recall,
    n_candidates``."""
    settings = sorted({(int(b), int(n)) for b, n in settings})
    widest = SignFamily(max(n for _, n in settings), max(b for b, _ in settings), seed)

    def low_bits(bits: int):
        mask = F.lit((1 << bits) - 1).cast("long")
        return lambda base: F.transform(base, lambda s: s.bitwiseAND(mask))

    variants = [Variant(low_bits(b), tuple(n for other, n in settings if other == b))
                for b in sorted({b for b, _ in settings})]
    names = [{"bits": b, "tables": n} for b, n in settings]
    return _scored(query, train, lambda col, w: signature_column(widest, w, col), variants, names, ks,
                   threshold, id_col, label, truth, opts)
