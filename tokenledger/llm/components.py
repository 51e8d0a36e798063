"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.tables import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links (a, b)``; a component is named by its least node.

    Each round every node takes the least name among its own and its neighbours', then the name of the node so named.
    Names travel along chains in a number of rounds that grows with their logarithm. Each round is a written table; the
    driver sees one count.
    """
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-links")
    names = stage(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("component")), "components-0")
    round_ = 0
    while True:
        round_ += 1
        near = both.join(names.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = names.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        heads = names.select(F.col("node").alias("component"), F.col("component").alias("head"))
        jumped = stage(step.join(heads, "component").select("node", "old", F.least("component", "head").alias("component")), f"components-{round_}")
        names = jumped.select("node", "component")
        if jumped.filter("old <> component").isEmpty():
            return names
