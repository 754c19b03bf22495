from pyspark.sql import functions as F

from annspark.functions.hashing import SignFamily
from annspark.operators.classify import knn_classify
from annspark.session import scratch_path
from annspark.sources import load_embeddings, split_query_train
from annspark.streaming import classify_stream
from tests.conftest import SF001


def test_stream_matches_batch(spark):
    df = load_embeddings(spark, SF001)
    q, t = split_query_train(df)
    src = scratch_path(spark, "stream-src")
    # Queries arrive as three files; one file per micro-batch.
    for part in range(3):
        q.where(F.pmod(F.col("id") / 5, F.lit(3)) == part).write.parquet(f"{src}/p{part}")
    stream = (spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    fam = SignFamily(8, 6, seed=1234)
    handle = classify_stream(stream, t, fam, out, ckpt, k=5)
    handle.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.select("epoch").distinct().count() >= 2
    want = knn_classify(q, t, fam, 5)
    cols = ["q_id", "label", "prediction", "n_candidates"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.select(*cols).collect())
    assert a == b
