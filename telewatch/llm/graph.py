"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.sources.tables import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `component`, the smallest node that it reaches. Nodes without a link are left out.

    Every round each node takes the smallest label among its neighbours and then that label's own label, so paths shrink by halves. A
    node with very many links only adds rows to sums that are combined before the exchange.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = materialise(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("old"))
        new = materialise(new, "labels")
        own = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(new.join(own, "label").select("node", F.col("next").alias("component"), "old"), "labels")
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
