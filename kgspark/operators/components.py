"""Connected components by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kgspark.staging import staged, unstaged


def _relabel(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    p = parents.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    return rows.join(p, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_root", column)).drop("_id", "_root")


def connected_components(edges: DataFrame) -> DataFrame:
    """id, root for each id of edges (a, b): root is the smallest id of the component.

    Each round every node takes its smallest neighbour as parent, chains are shortened by jumping
    until all point to a root, and the edges between roots go into the next round; the number of
    nodes with edges at least halves. Every step is written to the shared folder, so plans stay
    short. Rows with a null and loops link nothing; an empty table gives an empty table.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")))
        moved = 1
        while moved:
            seen = Observation()
            jumped = _relabel(parents.withColumn("was", F.col("root")), "root", parents)
            old, parents = parents, staged(jumped.observe(seen, F.count_if(F.col("was") != F.col("root")).alias("n")).select("id", "root"))
            unstaged(old)
            moved = seen.get["n"]
        old = labels
        labels = staged(parents if labels is None else _relabel(labels, "root", parents).unionByName(parents.join(labels.select("id"), "id", "left_anti")))
        left = staged(_relabel(_relabel(edges, "a", parents), "b", parents).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        unstaged(old, edges, parents)
        edges = left
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")) if labels is None else labels
