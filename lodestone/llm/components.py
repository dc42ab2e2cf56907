"""Connected components of a link table by contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table: a checkpoint would hand on the size that Catalyst expects of a join, whose digits double in every round."""
    path = f"{shared_folder(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> (node long, component long), component the smallest node reachable.

    In every round each node hooks to its smallest neighbour (a partial aggregate, so a hub costs no more than its
    share of links) and follows hooks to their end, doubling its reach with every join. Links are then drawn between hooks; those within one
    hook and repeated ones go, so later rounds work on what is still open only. The smallest node of a component
    never hooks elsewhere, so it is the one that is left. Joins start from stored tables (the second join of open links takes the
    first one's result), which lets adaptive execution split a hub's partition. Only whether links are left reaches the driver.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up")))
        settled = False
        while not settled:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut(hook.join(above, "up").select("node", "up", "top"))
            settled = jumped.where("top <> up").isEmpty()
            hook = jumped.select("node", F.col("top").alias("up"))
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            moved = hook.withColumnRenamed("node", "component")
            labels = cut(labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        first, second = hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        open_links = edges.join(first, "a").join(second, "b").where("ua <> ub")
        edges = cut(open_links.select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
