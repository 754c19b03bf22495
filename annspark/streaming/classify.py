"""Micro-batch k-NN classification of query vectors as they arrive.

The reference scores its test set in batches of about a thousand queries, one batch at
a time. Here the batches are the micro-batches of a Structured Streaming query: each
batch of new query rows runs the same batch plan (LSH search, re-rank, vote) against a
static training table that is hashed once and written as a Parquet index in the shared
checkpoint folder. Stream-static, no state
store. Every batch overwrites its own ``epoch=<id>`` folder, so a batch replayed after a
failure rewrites the same output (exactly once per epoch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annspark.functions.vectors import search_width
from annspark.operators.classify import knn_classify
from annspark.operators.index import build_index
from annspark.session import checkpoint_dir


def classify_stream(queries: DataFrame, train: DataFrame, family, output_path: str,
                    checkpoint_location: str, k: int = 5, threshold: float | None = None,
                    available_now: bool = True, processing_time: str | None = None,
                    id_col: str = "id", label: str = "label",
                    features: str = "features") -> StreamingQuery:
    """Start the stream; predictions land in ``output_path/epoch=<batch id>``."""
    if not queries.isStreaming:
        raise ValueError("queries must be a streaming DataFrame (spark.readStream)")
    spark = train.sparkSession
    checkpoint_dir(spark)
    width = search_width(train, col=features)
    index = build_index(train, family, width=width, id_col=id_col, features=features,
                        label=label)
    n_train = index.count()

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        n_q = batch.count()
        if n_q == 0:
            return
        preds = knn_classify(batch, index, family, k, threshold, id_col=id_col, label=label,
                             features=features, width=width, counts=(n_q, n_train),
                             train_sig="sig")
        (preds.withColumn("epoch", F.lit(epoch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/epoch={epoch_id}"))

    writer = (queries.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint_location))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
