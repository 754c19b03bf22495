"""Connected components of a link table, as joins and aggregates.

Every round gives each node the smallest id among itself and its neighbours, jumps along
these pointers, and replaces the links by links between the nodes pointed to. Links
inside one target vanish, so the table shrinks by half or more a round; the pointers of
all rounds chained give each node the smallest id of its component. Each table is written
to the shared folder, so a round never recomputes an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annspark.llm.common import written

JUMPS = 2


def _pairs(links: DataFrame, a: str, b: str) -> DataFrame:
    return (links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
            .where(F.col("a") < F.col("b")).distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node that occurs in ``links`` the smallest node id it can
    reach. Loops, repeated links and links with a null end are ignored; without links the
    result is empty."""
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    left = written(_pairs(links.select(F.col(a).cast("long").alias("a"),
                                       F.col(b).cast("long").alias("b")), "a", "b"), "links")
    label = None
    while label is None or not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        to = written(ends.groupBy("node").agg(F.min("other").alias("_m"))
                     .select("node", F.least("node", "_m").alias("root")), "pointers")
        for _ in range(JUMPS):
            hop = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            to = written(to.join(hop, "root").select("node", F.col("next").alias("root")), "pointers")
        first = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        second = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = written(_pairs(left.join(first, "a").join(second, "b"), "ra", "rb"), "links")
        if label is None:
            label = to
        else:
            hop = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = written(label.join(hop, "root", "left")
                            .select("node", F.coalesce("next", "root").alias("root")), "labels")
    return label
