"""Connected components of a link table, by rounds of smallest-label joins with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of links; comp is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so
    chains shrink by more than half. Labels live in written tables; the driver sees one count a round.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    edges = staged(both.union(both.select("y", "x")).distinct(), "edges")
    labels = staged(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("comp").alias("m"))
        stepped = labels.join(near, labels["node"] == near["x"]).select("node", F.least("comp", "m").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("over"))
        moved = staged(stepped.join(jump, "to").select("node", F.least("to", "over").alias("comp"), "was"), "labels")
        if moved.where("comp != was").limit(1).count() == 0:
            return moved.select("node", "comp")
        labels = moved.select("node", "comp")
