"""Connected components of links, without gathering them anywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslake.session import fresh_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def component_labels(links: DataFrame) -> DataFrame:
    """Smallest node of each node's component: (node, label) for every node of the links (a, b), nodes being longs.

    Each round every node takes the smallest label among itself and its neighbours, then the label of its label; rounds
    grow with the logarithm of a component's diameter for chains and end after two or three for stars. Labels of a round
    are written to the shared folder, which cuts the lineage. Sums and minima combine before the shuffle and the joins are
    plain equi-joins of two written tables, so a node with very many links can be split. Null ends are ignored.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = _written(ends.select("a", "b").union(ends.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = _written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        least = _written(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new")), "labels")
        jump = least.select(F.col("node").alias("new"), F.col("new").alias("next"))
        labels = _written(least.join(jump, "new").select("node", F.least("new", "next").alias("label"), (F.col("label") != F.least("new", "next")).alias("moved")), "labels")
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("node", "label")
