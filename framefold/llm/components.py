"""Connected components of a link table, wholly distributed.

Each round hooks every node to the neighbour, itself included, whose hash is least, follows that hook once more, and
contracts the links to the nodes that remain. Hashes are as good as random whatever the ids are, so a chain of rising ids
shrinks by a constant share in each round as other shapes do, and the rounds grow with the logarithm of the nodes. A last
step names each component by its least node. Rounds are cut off by written tables in the shared folder, which keeps plans
short and survives lost executors; those of past rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named by its least node.

    Links may repeat, come in either direction or join a node with itself; null ends are dropped. No links: no rows.
    """
    links = materialize(joined(links.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("root")), "labels")
    while links.limit(1).count():
        last = links, labels
        around = links.select(F.explode(F.array(F.struct(F.col("a").alias("old"), F.col("b").alias("new")), F.struct(F.col("b").alias("old"), F.col("a").alias("new")), F.struct(F.col("a").alias("old"), F.col("a").alias("new")), F.struct(F.col("b").alias("old"), F.col("b").alias("new")))).alias("x")).select("x.*")
        hooks = materialize(around.groupBy("old").agg(F.min_by("new", F.struct(F.xxhash64("new"), "new")).alias("new")), "hooks")
        twice = hooks.join(hooks.select(F.col("old").alias("new"), F.col("new").alias("newer")), "new").select("old", F.col("newer").alias("new"))
        twice = materialize(twice, "hooks")
        of_a, of_b = (twice.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")) for c in ("a", "b"))
        labels = materialize(labels.join(twice, labels["root"] == twice["old"], "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        links = materialize(joined(links.join(of_a, "a").join(of_b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))), "links")
        discard(*last, hooks, twice)
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")


def joined(links: DataFrame) -> DataFrame:
    """The distinct links between two nodes, the smaller one first."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
