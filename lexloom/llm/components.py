"""Connected components of a large graph by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import durable


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (least node reachable) for all nodes of `edges` (`a`, `b`).

    Each round joins every node to the least node around it, first for its
    larger neighbours (large star), then for its smaller ones (small star), and
    writes the edges, so a lost executor costs one round at most. A round takes
    a logarithmic share off every chain; it ends when nothing changes. Groups
    are reduced by `min` before their shuffle, so a node with very many
    neighbours sends one row from each task.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = durable(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = durable(least, "least")
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = durable(large, "links")
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        small = durable(small, "links")
        # Stars are stable: every node hangs on a node that hangs on none.
        changed = small.alias("x").join(small.alias("y"), F.col("x.v") == F.col("y.u")).limit(1).count()
        doubled = small.groupBy("u").count().where("count > 1").limit(1).count()
        links = small
        if not changed and not doubled:
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
