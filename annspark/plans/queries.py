"""Registered queries: each takes ``(spark, sf_dir)`` and returns a lazy DataFrame.

They read the driver's ``embeddings`` table (queries: ``id % 5 == 0``, training rows:
the rest; together the whole table). Outputs are scalar columns, distances rounded to
6 decimals, so results can be compared with the SQL oracles in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annspark.functions.vectors import (
    mint_ids,
    nonzeros,
    pad,
    vector_sq,
    vector_sum,
)
from annspark.operators.batches import BatchedSearch
from annspark.operators.bucketed import build_bucketed_index
from annspark.operators.classify import bucket_vote_classify, exact_classify, knn_classify, vote
from annspark.operators.evaluate import (
    accuracy,
    match_share,
    recall_at_k,
    strict_majority_accuracy,
    truth_from_lists,
)
from annspark.operators.index import (
    bucket_histogram,
    bucket_postings,
    bucket_summary,
    build_bucket_index,
    build_index,
    flatten_postings,
)
from annspark.operators.search import (
    exact_knn,
    knn_join,
    knn_one,
    knn_one_indexed,
    similarity_join,
)
from annspark.operators.late import late_knn_join
from annspark.operators.pruned import exact_knn_pruned
from annspark.operators.sweeps import sweep, sweep_sign
from annspark.plans import params as P
from annspark.session import scratch_path
from annspark.sources.csv import (
    read_csv_vectors,
    read_ground_truth,
    write_csv_vectors,
    write_ground_truth,
)
from annspark.sources.embeddings import load_embeddings, split_query_train
from annspark.sources.libsvm import load_pair, read_libsvm, write_libsvm
from annspark.sources.samples import bernoulli_sample, hash_sample, head_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def _r(c) -> F.Column:
    return F.round(c, P.ROUND)


def _r_pairs(name: str) -> F.Column:
    """``_r`` of the distances of many pairs. Rounding takes a value's decimal text, several times
    what the rest of a pair takes: here only values near a half do, the others give the same without."""
    x, scale = F.col(name), float(10 ** P.ROUND)
    up = x * F.lit(scale) + F.lit(0.5)
    whole = F.floor(up)
    clear = (up - whole >= 0.001) & (up - whole <= 0.999) & (F.abs(x) * F.lit(scale) < 1e12)
    return F.when(clear, whole / F.lit(scale)).otherwise(_r(x))


def _data(spark, sf_dir):
    df = load_embeddings(spark, sf_dir)
    q, t = split_query_train(df)
    return df, q, t


def _neighbours(nb: DataFrame) -> DataFrame:
    return nb.select("q_id", "t_id", F.col("t_label").cast("int").alias("t_label"),
                     _r("distance").alias("distance"), F.col("rn").cast("long").alias("rn"),
                     F.col("n_candidates").cast("long").alias("n_candidates"))


def _vector_stats(df: DataFrame) -> list:
    return [F.size("features").cast("long").alias("width"),
            nonzeros("features").cast("long").alias("nnz"),
            _r(vector_sum("features")).alias("vsum"),
            _r(vector_sq("features")).alias("vsq")]


# --- A. sources, samples, sinks ---------------------------------------------------

@query("libsvm_round_trip")
def libsvm_round_trip(spark, sf_dir):
    """train/test written as LibSVM, read back with one width and
    position ids."""
    _, q, t = _data(spark, sf_dir)
    train_path, test_path = scratch_path(spark, "libsvm-train"), scratch_path(spark, "libsvm-test")
    write_libsvm(t.orderBy("id"), train_path)
    write_libsvm(q.orderBy("id"), test_path)
    train, test = load_pair(spark, train_path, test_path)
    both = (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test"))))
    return both.select("split", F.col("id").cast("long").alias("row_id"), "label", *_vector_stats(both))


@query("libsvm_bz2")
def libsvm_bz2(spark, sf_dir):
    """A3: the whole table as bzip2-compressed LibSVM, decoded by the reader."""
    df, _, _ = _data(spark, sf_dir)
    path = scratch_path(spark, "libsvm-bz2")
    write_libsvm(df, path, compression="bzip2")
    back = read_libsvm(spark, path, P.WIDTH)
    return back.select("label", *_vector_stats(back))


@query("csv_vectors")
def csv_vectors(spark, sf_dir):
    """CSV with a header, one column per component, explicit schema."""
    df, _, _ = _data(spark, sf_dir)
    path = scratch_path(spark, "csv-vectors")
    write_csv_vectors(df, path, P.WIDTH)
    back = read_csv_vectors(spark, path, P.WIDTH)
    return back.select("id", *_vector_stats(back))


@query("csv_inferred")
def csv_inferred(spark, sf_dir):
    """A4 as the reference reads it: header plus type inference."""
    df, _, _ = _data(spark, sf_dir)
    path = scratch_path(spark, "csv-inferred")
    write_csv_vectors(df, path, P.WIDTH)
    back = read_csv_vectors(spark, path, None)
    return back.select("id", *_vector_stats(back))


@query("csv_ground_truth")
def csv_ground_truth(spark, sf_dir):
    """Exact neighbour lists written as headerless CSV and read back."""
    _, q, t = _data(spark, sf_dir)
    nb = exact_knn(q, t, P.K)
    lists = (nb.groupBy("q_id")
             .agg(F.array_sort(F.collect_list(F.struct("rn", "t_id"))).alias("_l"))
             .select(F.col("q_id").alias("query_id"),
                     F.transform("_l", lambda s: s["t_id"]).alias("neighbours")))
    path = scratch_path(spark, "csv-groundtruth")
    write_ground_truth(lists, path, P.K)
    gt = truth_from_lists(read_ground_truth(spark, path, P.K))
    return gt.select(F.col("q_id").alias("query_id"), F.col("rn").cast("long").alias("rank"),
                     F.col("t_id").alias("train_id"))


@query("head_sample")
def head_sample_q(spark, sf_dir):
    """The first rows by id, as a distributed top-n."""
    df, _, _ = _data(spark, sf_dir)
    return head_sample(df, P.HEAD_ROWS).select("id", "label", _r(vector_sum("features")).alias("vsum"))


@query("bernoulli_all")
def bernoulli_all(spark, sf_dir):
    """sample(false, 1.0) keeps every row."""
    df, _, _ = _data(spark, sf_dir)
    return bernoulli_sample(df, 1.0).select("id", "label")


@query("hash_sample")
def hash_sample_q(spark, sf_dir):
    """A7 below 1: rows drawn by a hash of their key, whatever the partitioning."""
    df, _, _ = _data(spark, sf_dir)
    return hash_sample(df, P.SAMPLE_FRACTION, seed=P.SAMPLE_SEED).select("id", "label")


@query("libsvm_sparse_knn")
def libsvm_sparse_knn(spark, sf_dir):
    """Train and test as LibSVM text with components near zero left out, read
    back sparse, searched and re-ranked sparse. Ids are positions in the files."""
    _, q, t = _data(spark, sf_dir)

    def thinned(df):
        kept = F.transform("features", lambda x: F.when(F.abs(x) < P.SPARSE_CUT, F.lit(0.0)).otherwise(x))
        return df.orderBy("id").withColumn("features", kept)

    train_path, test_path = scratch_path(spark, "sparse-train"), scratch_path(spark, "sparse-test")
    write_libsvm(thinned(t), train_path)
    write_libsvm(thinned(q), test_path)
    train, test = load_pair(spark, train_path, test_path, num_features=P.WIDTH, sparse=True)
    return _neighbours(knn_join(test, train, P.SIGN, P.K))


@query("result_view_projection")
def result_view_projection(spark, sf_dir):
    """Join result with nested structs, a temp view, projected by SQL."""
    _, q, t = _data(spark, sf_dir)
    pairs = similarity_join(q, t, P.SIGN, P.THRESHOLD)
    nested = pairs.join(q.select(F.col("id").alias("q_id"), F.col("label").alias("q_label")), "q_id")
    nested = nested.select(
        F.struct(F.col("t_id").alias("id"), F.col("t_label").cast("int").alias("label")).alias("datasetA"),
        F.struct(F.col("q_id").alias("id"), F.col("q_label").alias("label")).alias("datasetB"),
        F.col("distance").alias("EuclideanDistance"))
    view = f"results_{uuid.uuid4().hex}"  # one view per call: calls may run side by side
    nested.createOrReplaceTempView(view)
    return spark.sql(
        "SELECT datasetA.label AS label_train, datasetB.label AS label_test, "
        "datasetA.id AS train_id, datasetB.id AS test_id, "
        f"round(EuclideanDistance, {P.ROUND}) AS distance FROM {view}")


# --- B. vector functions and hashes -------------------------------------------------

@query("pad_vectors")
def pad_vectors(spark, sf_dir):
    """B2: zero padding to a wider width."""
    df, _, _ = _data(spark, sf_dir)
    padded = df.select("id", pad("features", P.PAD_WIDTH).alias("features"))
    return padded.select("id", F.size("features").cast("long").alias("width"),
                         _r(vector_sum("features")).alias("vsum"),
                         F.size(F.filter(F.slice("features", P.WIDTH + 1, P.PAD_WIDTH - P.WIDTH),
                                         lambda x: x == 0)).cast("long").alias("tail_zeros"))


@query("mint_ids")
def mint_ids_q(spark, sf_dir):
    """Consecutive ids in (label, id) order without a one-partition window."""
    df, _, _ = _data(spark, sf_dir)
    return mint_ids(df.select("id", "label"), ["label", "id"], "row_id").select("id", "row_id")


@query("sign_signatures")
def sign_signatures(spark, sf_dir):
    """Packed sign bits per table, one row per (row, table)."""
    df, _, _ = _data(spark, sf_dir)
    from annspark.operators.index import bucket_index
    return bucket_index(df, P.SIGN, P.WIDTH).select("id", F.col("tbl").cast("int"), "bucket")


@query("euclid_hashes")
def euclid_hashes(spark, sf_dir):
    """Bucketed projections per table."""
    df, _, _ = _data(spark, sf_dir)
    from annspark.operators.index import bucket_index
    return bucket_index(df, P.EUCLID, P.WIDTH).select("id", F.col("tbl").cast("int"), "bucket")


# --- C/D. joins and search ------------------------------------------------------------

@query("similarity_join")
def similarity_join_q(spark, sf_dir):
    """Sign buckets, pairs within the threshold, each once."""
    _, q, t = _data(spark, sf_dir)
    pairs = similarity_join(q, t, P.SIGN, P.THRESHOLD, near_first=True)
    return pairs.select("q_id", "t_id", _r_pairs("distance").alias("distance"))


@query("similarity_join_euclid")
def similarity_join_euclid(spark, sf_dir):
    """D1 with the Euclidean family (the reference's batch join)."""
    _, q, t = _data(spark, sf_dir)
    pairs = similarity_join(q, t, P.EUCLID, P.THRESHOLD, near_first=True)
    return pairs.select("q_id", "t_id", _r_pairs("distance").alias("distance"))


@query("similarity_join_default")
def similarity_join_default(spark, sf_dir):
    """D1, C2 without a threshold: the reference's cut of 2.5 per dimension."""
    _, q, t = _data(spark, sf_dir)
    pairs = similarity_join(q, t, P.SIGN, near_first=True)
    return pairs.select("q_id", "t_id", _r_pairs("distance").alias("distance"))


@query("search_one_key")
def search_one_key(spark, sf_dir):
    """K nearest of one key vector (the row with the smallest id) in the whole table."""
    df, _, _ = _data(spark, sf_dir)
    key = df.orderBy("id").select("features").first()["features"]
    res = knn_one(df, key, P.SIGN, P.K)
    return res.select("id", "label", _r("distance").alias("distance"),
                      F.col("rn").cast("long").alias("rn"))


@query("search_one_key_indexed")
def search_one_key_indexed(spark, sf_dir):
    """F4 through the long-form bucket index: the same key and answer as
    ``search_one_key``, reading only the key's bucket in each table."""
    df, _, _ = _data(spark, sf_dir)
    key = df.orderBy("id").select("features").first()["features"]
    path = build_bucket_index(df, P.SIGN, width=P.WIDTH)
    res = knn_one_indexed(spark, path, key, P.SIGN, P.K)
    return res.select("id", "label", _r("distance").alias("distance"),
                      F.col("rn").cast("long").alias("rn"))


@query("batch_top_k")
def batch_top_k(spark, sf_dir):
    """Per-query top k of the sign-LSH candidates."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(knn_join(q, t, P.SIGN, P.K))


@query("late_top_k")
def late_top_k(spark, sf_dir):
    """``batch_top_k`` on one-byte codes, vectors fetched once for the pairs
    that bounds leave."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(late_knn_join(q, t, P.SIGN, P.K))


@query("late_rerank_classify")
def late_rerank_classify(spark, sf_dir):
    """H5 with late materialisation, blocks split and crowded ones compared on vectors."""
    _, q, t = _data(spark, sf_dir)
    return vote(late_knn_join(q, t, P.HOT, P.K, block_rows=P.SPLIT_ROWS, max_pairs=1), q)


@query("indexed_search")
def indexed_search(spark, sf_dir):
    """Training rows hashed once into a Parquet index, then searched (top k per
    query and one key) without hashing the training side again."""
    _, q, t = _data(spark, sf_dir)
    index = build_index(t, P.SIGN)
    return _neighbours(knn_join(q, index, P.SIGN, P.K, train_sig="sig"))


@query("bucketed_index_search")
def bucketed_index_search(spark, sf_dir):
    """The index as a bucketed table with a manifest, read in place."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(build_bucketed_index(t, P.SIGN, block_rows=P.SPLIT_ROWS).search(q, P.SIGN, P.K))


@query("batched_queries")
def batched_queries(spark, sf_dir):
    """Queries packed into batches by their candidate pairs, searched one after another
    (small ones in rounds) against one bucketed index, each committed."""
    _, q, t = _data(spark, sf_dir)
    run = BatchedSearch(q, t, P.EUCLID, P.K, max_pairs=P.BATCH_PAIRS)
    run.run()
    return _neighbours(run.results()).join(run.plan().select("q_id", "batch", "n_pairs"), "q_id")


@query("euclid_knn")
def euclid_knn(spark, sf_dir):
    """H1: Euclidean LSH join, threshold, top k per query."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(knn_join(q, t, P.EUCLID, P.K, P.THRESHOLD))


@query("exact_knn")
def exact_knn_q(spark, sf_dir):
    """Exact top k over blocks of the query x training grid."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(exact_knn(q, t, P.K))


@query("exact_knn_pruned")
def exact_knn_pruned_q(spark, sf_dir):
    """The same answer as ``exact_knn`` from rings around pivots, skipping those the
    triangle inequality rules out."""
    _, q, t = _data(spark, sf_dir)
    nb = exact_knn_pruned(q, t, P.K, block_rows=P.SPLIT_ROWS)
    return nb.select("q_id", "t_id", F.col("t_label").cast("int").alias("t_label"), _r("distance").alias("distance"),
                     F.col("rn").cast("long").alias("rn"))


@query("exact_self_knn")
def exact_self_knn(spark, sf_dir):
    """Every row of the table against the whole table, the row itself left out."""
    df, _, _ = _data(spark, sf_dir)
    return _neighbours(exact_knn(df, df, P.K, exclude_self=True))


def _dirty(df: DataFrame) -> DataFrame:
    """The whole table with three in seven vectors spoilt by id: null, NaN, infinite."""
    def first_is(value):
        bad = F.lit(value).cast("float")
        return F.transform("features", lambda x, i: F.when(i == 0, bad).otherwise(x))

    kind = F.pmod(F.col("id"), F.lit(7))
    return df.withColumn("features", F.when(kind == 1, first_is(float("nan")))
                         .when(kind == 2, first_is(float("inf"))).when(kind > 2, F.col("features")))


@query("knn_dirty_vectors")
def knn_dirty_vectors(spark, sf_dir):
    """Rows without a usable vector are no queries and no candidates."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(exact_knn(_dirty(q), _dirty(t), P.K))


@query("bucket_vote_dirty")
def bucket_vote_dirty(spark, sf_dir):
    """The same rule in the bucket vote; such queries are reported with -1."""
    _, q, t = _data(spark, sf_dir)
    return bucket_vote_classify(_dirty(q), _dirty(t), P.SIGN, P.WIDTH)


@query("knn_large_values")
def knn_large_values(spark, sf_dir):
    """Components beyond float32's squares (x 1e20); distances given over 1e20."""
    _, q, t = _data(spark, sf_dir)

    def scaled(df):
        return df.withColumn("features", F.transform("features", lambda x: x.cast("double") * F.lit(1e20)))

    nb = exact_knn(scaled(q), scaled(t), P.K)
    return _neighbours(nb.withColumn("distance", F.col("distance") / F.lit(1e20)))


@query("batch_top_k_split")
def batch_top_k_split(spark, sf_dir):
    """``batch_top_k`` with small blocks and no broadcast: hot buckets are split, their
    list goes through the salted shuffle join."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(knn_join(q, t, P.SIGN, P.K, block_rows=P.SPLIT_ROWS, max_broadcast_rows=0))


@query("exact_knn_split")
def exact_knn_split(spark, sf_dir):
    """``exact_knn`` over a grid of many small blocks."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(exact_knn(q, t, P.K, block_rows=P.SPLIT_ROWS))


@query("hot_bucket_knn")
def hot_bucket_knn(spark, sf_dir):
    """One bit per table: each bucket holds about half of all rows and is split."""
    _, q, t = _data(spark, sf_dir)
    return _neighbours(knn_join(q, t, P.HOT, P.K, block_rows=P.SPLIT_ROWS))


# --- E. index, votes and scores ----------------------------------------------------------

@query("bucket_histogram")
def bucket_histogram_q(spark, sf_dir):
    """Label counts per (table, bucket)."""
    df, _, _ = _data(spark, sf_dir)
    return bucket_histogram(df, P.SIGN, P.WIDTH).select(
        F.col("tbl").cast("int"), "bucket", "label", F.col("cnt").cast("long"))


@query("bucket_members")
def bucket_members(spark, sf_dir):
    """Bucket sizes and id sums (members stay a long table)."""
    df, _, _ = _data(spark, sf_dir)
    return bucket_summary(df, P.SIGN, P.WIDTH).select(
        F.col("tbl").cast("int"), "bucket", F.col("n_members").cast("long"),
        F.col("id_sum").cast("long"), "id_min", "id_max")


@query("bucket_postings")
def bucket_postings_q(spark, sf_dir):
    """Member lists of bounded length; here few ids a list, so buckets have several."""
    df, _, _ = _data(spark, sf_dir)
    rows = bucket_postings(df, P.HOT, P.WIDTH, list_ids=P.POSTING_IDS)
    lists = F.col("lists")
    return (rows.groupBy("tbl", "bucket").agg(
        F.sum("n_members").alias("n_members"), F.min(F.get(lists, F.lit(0))["first"]).alias("first_id"),
        F.max(F.array_max(F.transform(lists, lambda p: p["first"] + F.array_max(p["offsets"])))).alias("last_id"),
        F.bool_and(F.forall(lists, lambda p: F.size(p["offsets"]) <= P.POSTING_IDS)).alias("bounded"))
        .select(F.col("tbl").cast("int").alias("tbl"), "bucket", "n_members", "first_id", "last_id", "bounded"))


@query("flatten_postings")
def flatten_postings_q(spark, sf_dir):
    """The lists written, read and flattened to one row a member."""
    df, _, _ = _data(spark, sf_dir)
    path = scratch_path(spark, "postings")
    bucket_postings(df, P.SIGN, P.WIDTH, list_ids=P.POSTING_IDS).write.parquet(path)
    return flatten_postings(spark.read.parquet(path)).select(F.col("tbl").cast("int").alias("tbl"), "bucket", "id")


@query("bucket_vote")
def bucket_vote(spark, sf_dir):
    """Histogram vote over the query's buckets, -1 without any."""
    _, q, t = _data(spark, sf_dir)
    return bucket_vote_classify(q, t, P.SIGN, P.WIDTH)


@query("rerank_classify")
def rerank_classify(spark, sf_dir):
    """Sign LSH, re-rank by distance, vote of the top k."""
    _, q, t = _data(spark, sf_dir)
    return knn_classify(q, t, P.SIGN, P.K)


@query("euclid_classify")
def euclid_classify(spark, sf_dir):
    """H2, E5: Euclidean LSH classifier, one plan for all queries."""
    _, q, t = _data(spark, sf_dir)
    return knn_classify(q, t, P.EUCLID, P.K)


@query("exact_classify")
def exact_classify_q(spark, sf_dir):
    """H6: exact k-NN classifier."""
    _, q, t = _data(spark, sf_dir)
    return exact_classify(q, t, P.K)


@query("classify_text_labels")
def classify_text_labels(spark, sf_dir):
    """Text labels on the training side come back as predictions; their number
    is what the queries carry."""
    _, q, t = _data(spark, sf_dir)
    named = t.withColumn("label", F.concat(F.lit("class "), F.col("label").cast("string")))
    asked = q.withColumn("label", F.concat(F.lit("class "), F.col("label").cast("string")))
    return knn_classify(asked, named, P.SIGN, P.K)


@query("match_share")
def match_share_q(spark, sf_dir):
    """Share of the k neighbours with the query's label (H1's score)."""
    _, q, t = _data(spark, sf_dir)
    nb = knn_join(q, t, P.EUCLID, P.K, P.THRESHOLD)
    return match_share(nb, q).select("q_id", F.col("n_neighbours").cast("long"),
                                     F.col("n_match").cast("long"), _r("share").alias("share"))


@query("strict_majority_accuracy")
def strict_majority_q(spark, sf_dir):
    """Queries whose neighbours match in more than half, over all queries."""
    _, q, t = _data(spark, sf_dir)
    nb = knn_join(q, t, P.EUCLID, P.K, P.THRESHOLD)
    return strict_majority_accuracy(nb, q).select(
        F.col("n_queries").cast("long"), F.col("n_majority").cast("long"),
        _r("accuracy").alias("accuracy"))


@query("accuracy_train_test")
def accuracy_train_test(spark, sf_dir):
    """Training rows (self left out) and test rows scored in one run."""
    _, q, t = _data(spark, sf_dir)
    return _both_scored(knn_classify(t, t, P.SIGN, P.K, exclude_self=True), knn_classify(q, t, P.SIGN, P.K))


def _both_scored(train_pred: DataFrame, test_pred: DataFrame) -> DataFrame:
    parts = [accuracy(p).select(F.lit(name).alias("split"), F.col("n").cast("long"),
                                F.col("hits").cast("long"), _r("accuracy").alias("accuracy"))
             for name, p in (("train", train_pred), ("test", test_pred))]
    return parts[0].unionByName(parts[1])


@query("accuracy_bucket_vote")
def accuracy_bucket_vote(spark, sf_dir):
    """H8, H4: the bucket vote scored on training rows (their own vote taken out) and on
    test rows."""
    _, q, t = _data(spark, sf_dir)
    return _both_scored(bucket_vote_classify(t, t, P.SIGN, P.WIDTH, exclude_self=True),
                        bucket_vote_classify(q, t, P.SIGN, P.WIDTH))


@query("accuracy_exact")
def accuracy_exact(spark, sf_dir):
    """H8, H6: the exact classifier scored on training rows (self left out) and test rows."""
    _, q, t = _data(spark, sf_dir)
    return _both_scored(exact_classify(t, t, P.K, exclude_self=True), exact_classify(q, t, P.K))


@query("neighbour_lists")
def neighbour_lists(spark, sf_dir):
    """Each query's neighbour ids in rank order (bounded by k)."""
    _, q, t = _data(spark, sf_dir)
    nb = knn_join(q, t, P.EUCLID, P.K)
    return (nb.groupBy("q_id")
            .agg(F.array_sort(F.collect_list(F.struct("rn", "t_id"))).alias("_l"))
            .select("q_id", F.array_join(F.transform("_l", lambda s: s["t_id"].cast("string")), ",")
                    .alias("neighbours")))


@query("recall_at_k")
def recall_at_k_q(spark, sf_dir):
    """Euclidean LSH top k against the exact top k."""
    _, q, t = _data(spark, sf_dir)
    pred = knn_join(q, t, P.EUCLID, P.K)
    truth = exact_knn(q, t, P.K)
    return recall_at_k(pred, truth, q, P.K, P.GT_DEPTH).select(
        F.col("k").cast("long").alias("k"), "n_queries", "hits", _r("recall").alias("recall"))


@query("csv_recall_pipeline")
def csv_recall_pipeline(spark, sf_dir):
    """H3 end to end from files without keys: base and query vectors as CSV with a header
    (types inferred), exact neighbours as a headerless CSV of 1-based base positions, one
    row per query; LSH search on what was read, recall against the file's lists."""
    _, q, t = _data(spark, sf_dir)
    q = mint_ids(q, ["id"], "pos").withColumn("id", F.col("pos")).drop("pos")
    t = mint_ids(t, ["id"], "pos").withColumn("id", F.col("pos")).drop("pos")
    base_path, query_path = scratch_path(spark, "base-csv"), scratch_path(spark, "query-csv")
    write_csv_vectors(t.orderBy("id"), base_path, P.WIDTH, id_col=None)
    write_csv_vectors(q.orderBy("id"), query_path, P.WIDTH, id_col=None)
    gt_path = scratch_path(spark, "groundtruth-csv")
    lists = (exact_knn(q, t, P.K).groupBy("q_id")
             .agg(F.array_sort(F.collect_list(F.struct("rn", "t_id"))).alias("_l"))
             .select(F.col("q_id").alias("query_id"),
                     F.transform("_l", lambda s: s["t_id"] + 1).alias("neighbours")))
    write_ground_truth(lists, gt_path, P.K, with_query=False)
    base = read_csv_vectors(spark, base_path, id_col=None)
    queries = read_csv_vectors(spark, query_path, id_col=None)
    truth = truth_from_lists(read_ground_truth(spark, gt_path, with_query=False, gt_base=1))
    pred = knn_join(queries, base, P.EUCLID, P.K)
    return recall_at_k(pred, truth, queries, P.K, P.GT_DEPTH).select(
        F.col("k").cast("long").alias("k"), "n_queries", "hits", _r("recall").alias("recall"))


@query("sweep")
def sweep_q(spark, sf_dir):
    """H7: the 3 x 3 x 3 grid of bucket length, tables and k from one projection and one pass."""
    _, q, t = _data(spark, sf_dir)
    res = sweep(q, t, P.SWEEP_BUCKET_LENGTHS, P.SWEEP_TABLES, P.SWEEP_KS)
    return res.select("bl", F.col("nht").cast("long").alias("nht"), F.col("k").cast("long").alias("k"),
                      _r("accuracy").alias("accuracy"), _r("recall").alias("recall"),
                      F.col("n_candidates").cast("long").alias("n_candidates"))


@query("sweep_sign")
def sweep_sign_q(spark, sf_dir):
    """H7 for the sign family: the launch script's settings of bits and tables, from one
    hashing of the widest."""
    _, q, t = _data(spark, sf_dir)
    res = sweep_sign(q, t, P.SWEEP_SIGN, P.SWEEP_KS)
    return res.select(F.col("bits").cast("long").alias("bits"), F.col("tables").cast("long").alias("tables"),
                      F.col("k").cast("long").alias("k"), _r("accuracy").alias("accuracy"),
                      _r("recall").alias("recall"), F.col("n_candidates").cast("long").alias("n_candidates"))
