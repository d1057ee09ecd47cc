"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``a``-``b`` links.

    Nodes may be of any orderable type. Each round hands every node the smallest root
    among its neighbours and then the root of that root; rounds end when no root
    changes, so long chains take a logarithmic number of them in practice. Every
    round's labels are written to the shared folder.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(
        edges.groupBy("a").agg(F.min("b").alias("low"))
        .select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
    )
    while True:
        around = (
            edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        )
        lower = labels.join(around, labels.node == around.a, "left").select(
            "node", "root", F.least("root", "low").alias("next")
        )
        above = labels.select(F.col("node").alias("at"), F.col("root").alias("top"))
        jumped = lower.join(above, lower.next == above.at, "left").select(
            "node", F.coalesce(F.least("next", "top"), F.col("next")).alias("root"),
            (F.coalesce(F.least("next", "top"), F.col("next")) != F.col("root")).alias("moved"),
        )
        step = cut(jumped)
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels
