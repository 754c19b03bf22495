"""Scale run on generated vectors (not a registered query): time, stages, exactness.

usage: python tools/scale_run.py SCRATCH_DIR [n_train] [n_query] [--copies] [--block-rows=N]

Vectors are drawn by Spark (``spark.range`` + seeded ``randn``, unit length, stored as
float). With ``--copies`` every third row of both tables is the same vector, so one
bucket per table holds a third of all rows and every copy query ties with every copy;
the check is then that each copy query gets the five lowest copy ids at distance 0.
Stage times and shuffle bytes come from Spark's event log in the scratch folder.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from annspark import SignFamily, knn_join  # noqa: E402
from annspark.session import get_session  # noqa: E402

WIDTH = 64


def generate(spark, n, seed, start, copies):
    comps = [F.randn(seed * 1000 + i) for i in range(WIDTH)]
    base = spark.range(start, start + n, numPartitions=16).select(
        "id", *[comps[i].alias(f"c{i}") for i in range(WIDTH)])
    cols = [F.col(f"c{i}") for i in range(WIDTH)]
    if copies:
        hot = F.col("id") % 3 == 0
        cols = [F.when(hot, F.lit(1.0 if i == 0 else 0.0)).otherwise(c) for i, c in enumerate(cols)]
    norm = F.sqrt(sum(c * c for c in cols))
    return base.select("id", F.array(*[(c / norm).cast("float") for c in cols]).alias("features"),
                       (F.col("id") % 10).cast("int").alias("label"))


def stage_report(event_dir):
    import zstandard

    lines = []
    for path in glob.glob(f"{event_dir}/*/*") + glob.glob(f"{event_dir}/*"):
        if os.path.isdir(path) or "appstatus" in path:
            continue
        with open(path, "rb") as fh:
            raw = fh.read()
        if path.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(__import__("io").BytesIO(raw)).read()
        lines += raw.decode().splitlines()
    for line in lines:
        e = json.loads(line)
        if e["Event"] != "SparkListenerStageCompleted":
            continue
        si = e["Stage Info"]
        acc = {a["Name"]: a.get("Value", 0) for a in si["Accumulables"]}
        print(f"stage {si['Stage ID']:3d} wall {(si['Completion Time'] - si['Submission Time']) / 1000:6.1f}s "
              f"tasks {si['Number of Tasks']:4d} cpu {float(acc.get('internal.metrics.executorRunTime', 0)) / 1000:7.1f}s "
              f"shuffle-write {float(acc.get('internal.metrics.shuffle.write.bytesWritten', 0)) / 1e6:8.1f}MB")


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    copies = "--copies" in sys.argv
    block_rows = next((int(a.split("=")[1]) for a in sys.argv if a.startswith("--block-rows=")), None)
    scratch = args[0]
    n_train = int(args[1]) if len(args) > 1 else 400_000
    n_query = int(args[2]) if len(args) > 2 else 20_000
    events = f"{scratch}/events"
    os.makedirs(events, exist_ok=True)
    spark = get_session("local[8]", shuffle_partitions=64, conf={
        "spark.driver.memory": "16g", "spark.local.dir": f"{scratch}/local",
        "spark.checkpoint.dir": f"{scratch}/checkpoints",
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}"})
    generate(spark, n_train, 1, 0, copies).write.mode("overwrite").parquet(f"{scratch}/train")
    generate(spark, n_query, 2, 10_000_000, copies).write.mode("overwrite").parquet(f"{scratch}/query")
    train, query = spark.read.parquet(f"{scratch}/train"), spark.read.parquet(f"{scratch}/query")
    t0 = time.time()
    opts = {"block_rows": block_rows} if block_rows else {}
    res = knn_join(query, train, SignFamily(8, 6), k=5, **opts)
    t1 = time.time()
    res.write.mode("overwrite").parquet(f"{scratch}/result")
    t2 = time.time()
    out = spark.read.parquet(f"{scratch}/result")
    summary = out.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("q_id").alias("queries"),
                      F.avg("n_candidates").alias("avg_candidates")).first().asDict()
    print(json.dumps({"planning_sec": round(t1 - t0, 1), "search_sec": round(t2 - t1, 1), **summary}))
    if copies:
        hot = out.where(F.col("q_id") % 3 == 0)
        wrong = hot.where(~F.col("t_id").isin(0, 3, 6, 9, 12) | (F.col("distance") != 0.0)).count()
        print(json.dumps({"copy_queries": hot.select("q_id").distinct().count(), "wrong_rows": wrong}))
    spark.stop()
    stage_report(events)


if __name__ == "__main__":
    main()
