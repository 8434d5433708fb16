"""Connected components of an edge list by joins: no list of edges passes through the driver.

Defined results: edges with a null end, loops and repeated edges add nothing; a node that is in no
other edge is not listed; an empty list gives no row. Ids may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonloom.session import ensure_checkpoint_dir


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("node"), F.least(a, b).alias("other")]


def _to_roots(tree: DataFrame) -> DataFrame:
    """node, root of each node of a forest given by parents; every step doubles the distance."""
    while True:
        tree = tree.checkpoint()
        up = tree.filter("node <> root").select(
            F.col("node").alias("root"), F.col("root").alias("upper")
        )
        if tree.join(up, "root", "left_semi").isEmpty():
            return tree
        tree = tree.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `label` for every node of an edge; the label is the least node of its component.

    Every round hooks each node to its least neighbour, if that is less than itself, follows the
    hooks to their ends, and renames both ends of all edges to these. Loops and repeated edges then
    go, so the list shrinks: only nodes less than all their neighbours remain, at most half of them
    where ids are hashes. Rounds are checkpointed to the shared folder. A node of very many edges is
    added up before the shuffle; the joins are plain ones, which the adaptive planner splits where a
    key is hot.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select(*_ordered(a, b)).filter("node <> other").distinct().checkpoint()
    labels = links.select("node", F.col("other").alias("label")).limit(0)
    first = True
    while not links.isEmpty():
        back = links.select(F.col("other").alias("node"), F.col("node").alias("other"))
        near = links.unionByName(back).groupBy("node").agg(F.min("other").alias("near"))
        roots = _to_roots(near.select("node", F.least("node", "near").alias("root")))
        ends = roots.select(F.col("node").alias("other"), F.col("root").alias("other_root"))
        renamed = links.join(roots, "node").join(ends, "other").filter("root <> other_root")
        links = renamed.select(*_ordered("root", "other_root")).distinct().checkpoint()
        if first:
            labels, first = roots.select("node", F.col("root").alias("label")), False
        else:
            further = roots.select(F.col("node").alias("label"), "root")
            labels = labels.join(further, "label", "left").select(
                "node", F.coalesce("root", "label").alias("label")
            )
            labels = labels.checkpoint()
    return labels
