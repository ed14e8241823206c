"""Connected components of an edge table by alternating star contraction.

Each round is two joins; a node with very many edges is no hot spot, because
minima are pre-aggregated and the joins read written tables, whose partitions
adaptive execution may split.  Rounds grow with the logarithm of a component's
size.  Every round is written to the shared folder, so a lost executor costs a
task and not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulplan.staging import stage


def _pull(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them and the node.

    ``edges`` point from the larger to the smaller node.  One way, a node pulls
    its smaller neighbours; both ways, its larger ones.
    """
    turned = edges.union(edges.select("b", "a").toDF("a", "b")) if both_ways else edges
    least = stage(turned.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
    pulled = turned.where("b > a") if both_ways else turned
    pulled = pulled.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not both_ways:
        pulled = pulled.union(least.select("a", F.col("low").alias("b")))
    return stage(pulled.where("a > b").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node that is not the smallest of its component.

    ``edges`` has two integer columns ``a, b`` in any order; self links and
    repeats do not matter, null ends are not allowed.
    """
    stars = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = None
    while True:
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        stars = _pull(_pull(stars, True), False)
