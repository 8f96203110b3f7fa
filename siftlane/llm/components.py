"""Connected components of an edge table, each labelled with its smallest node."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm.common import stage, unstage


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of edges (src long, dst long); nulls and loops are left out.

    In each round a node, and the node that its label names, take the smallest label that a neighbour's
    label has; then labels are followed one step on. Whole trees of labels are hung onto one another,
    so a chain of 100,000 nodes, however numbered, takes about 18 rounds. Rounds go on until no label
    changes. Tables of each round are staged, those of the round before deleted; the result is the last
    of them, for unstage().
    """
    e = edges.where("src is not null and dst is not null and src <> dst")
    both = stage(e.select("src", "dst").union(e.select("dst", "src")).distinct(), f"{name}-edges")
    labels = stage(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"), F.lit(True).alias("changed")), f"{name}-0")
    for k in itertools.count(1):
        beyond = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        ahead = labels.select("node", "component").join(beyond, F.col("component") == F.col("at")).drop("at")
        near = both.join(ahead.select(F.col("node").alias("dst"), "beyond"), "dst").groupBy("src").agg(F.min("beyond").alias("near"))
        low = ahead.join(near, F.col("node") == F.col("src")).select("node", F.col("component").alias("was"), F.least("beyond", "near").alias("low"))
        hook = low.groupBy(F.col("was").alias("root")).agg(F.min("low").alias("hook"))
        found = F.least("was", "low", "hook")
        new = low.join(hook, F.col("node") == F.col("root"), "left").select("node", found.alias("component"), (found < F.col("was")).alias("changed"))
        new = stage(new, f"{name}-{k}")
        unstage(labels)
        labels = new
        if not labels.where("changed").head(1):
            break
    unstage(both)
    out = labels.select("node", "component")
    out._staged_path = labels._staged_path
    return out
