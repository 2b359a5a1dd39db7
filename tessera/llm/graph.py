"""Connected components of links between text digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of the links is connected with.

    Each round takes the least root among the neighbours and then the root's own root, so long chains halve. A node that very
    many links lead to, and a root of very many nodes, are split among tasks. Rounds are written to the shared folder, each in
    place of the one before; only whether a node changed reaches the driver.
    """
    spark = edges.sparkSession
    links, links_at = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    roots, at = saved(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = salted_join(links.withColumnRenamed("v", "node"), roots, ["node"], by="u").groupBy("u").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.node == near.u).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        step, step_at = saved(step)
        up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        now = salted_join(step, up, ["root"], by="node").select("node", "was", F.least("root", "higher").alias("root"))
        now, now_at = saved(now)
        discard(spark, [at, step_at])
        roots, at = now.select("node", "root"), now_at
        if not now.filter("root <> was").limit(1).count():
            discard(spark, [links_at])
            return roots
