"""Connected components of a table of links, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, table


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """links: a, b (long). Returns node, component (smallest node reachable) for every node that has a link.

    Each round takes the smallest label among neighbours, then the label's own label (pointer jumping), so paths shrink
    by half or more; every round is a written table. Stops when no label changes.
    """
    with scratch(links.sparkSession) as work:
        edges = table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
        labels = table(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
        for _ in range(rounds):
            nearest = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
            hooked = labels.join(nearest, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "m").alias("near"))
            jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
            new = table(hooked.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("component"), "old"), "labels")
            changed = new.where("component <> old").limit(1).count()
            labels = new.select("node", "component")
            if not changed:
                break
        else:
            raise RuntimeError("components did not settle")
        return work.result(labels, "components")
