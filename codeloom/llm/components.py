"""Distributed union-find: connected components by hooking to the least neighbour and contraction.

Each round every node points to its least neighbour (if that is less than itself), pointers
are doubled until they reach roots, and edges are rewritten between roots. Every component
that isn't done at least halves its roots, so rounds and doublings are logarithmic. All
tables are written to the shared folder, and joins read plain tables, so that Spark can
split a hub's rows among tasks. The rounds' tables are deleted in the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import cut as written
from codeloom.llm.scratch import drop_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node reachable) for the nodes of ``edges``; loops and nulls are dropped."""
    used: list[DataFrame] = []

    def cut(df: DataFrame, name: str) -> DataFrame:
        used.append(written(df, name))
        return used[-1]

    live = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        # The larger end of an edge hooks to the least of its smaller ends; other nodes are roots for now.
        up = cut(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "up")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("_top"))
            stepped = up.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root"), F.col("_top").isNotNull().alias("_moved"))
            stepped = cut(stepped, "up")
            moved = not stepped.where("_moved").isEmpty()
            up = stepped.drop("_moved")
            if not moved:
                break
        to_a = up.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
        to_b = up.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
        moved_edges = live.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("_ra", "a").alias("_x"), F.coalesce("_rb", "b").alias("_y"))
        live = cut(moved_edges.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).where("a < b").distinct(), "edges")
        if labels is None:
            labels = up
        else:
            later = up.select(F.col("node").alias("root"), F.col("root").alias("_top"))
            old = labels.join(later, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
            labels = cut(old.unionByName(up), "labels")  # what hooks now was a root before, and so isn't in labels
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)  # one empty table stays
    roots = labels.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = written(labels.unionByName(roots).select("node", F.col("root").alias("component")), "components")
    for table in used:
        drop_table(table)
    return out
