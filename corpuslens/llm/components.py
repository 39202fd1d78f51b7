"""Connected components of a table of links, by repeated contraction.

Every round points each node to the smallest of itself and its neighbours, follows these pointers
to their ends by doubling, and rewrites the links by where they lead, until no link joins two
different nodes. Pointers always go to smaller nodes, so they end; a chain of n takes log2(n) steps. Rows move by ``groupBy`` with partial sums and by
joins on nodes; each round's tables are written to the checkpoint folder, so the plan and the guess
of its size stay short and a lost executor costs no earlier round. Nothing is collected or
broadcast; the driver asks only whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.bounded import shuffled, unsized


def _links(links: DataFrame) -> DataFrame:
    return (links.filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, values of one type that have an
    order); ``component`` is the smallest node that can be reached."""
    left = unsized(_links(links.select("a", "b")))
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parents = unsized(both.groupBy(F.col("a").alias("child"))
                          .agg(F.least(F.min("b"), F.first("a")).alias("parent")))
        moving = True
        while moving:
            further = parents.select(F.col("child").alias("parent"),
                                     F.col("parent").alias("further"))
            step = unsized(parents.select("child", "parent").join(
                shuffled(further), "parent").select(
                "child", F.col("further").alias("parent"),
                (F.col("further") != F.col("parent")).alias("moved")))
            moving = not step.filter("moved").isEmpty()
            parents = step
        parents = parents.select("child", "parent")
        if labels is None:
            labels = parents.select(F.col("child").alias("node"), F.col("parent").alias("label"))
        else:
            labels = unsized(
                labels.join(shuffled(parents), F.col("label") == F.col("child"), "left").select(
                    "node", F.coalesce("parent", "label").alias("label")))
        other = parents.select(F.col("child").alias("child_b"), F.col("parent").alias("parent_b"))
        left = unsized(_links(
            left.join(shuffled(parents), F.col("a") == F.col("child"))
            .join(shuffled(other), F.col("b") == F.col("child_b"))
            .select(F.col("parent").alias("a"), F.col("parent_b").alias("b"))))
    if labels is None:
        labels = left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.withColumnRenamed("label", "component")
