"""Similarity graphs: symmetric closure, connected components, degree.

Edges are rows ``(src, dst)``.  Components come from alternating large and small
stars (Kiveris et al., 2014): each step is a partial aggregation and a join, so
nodes with very many neighbours stay spread, and the number of rounds grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, materialise


def symmetric_edges(pairs: DataFrame, a: str = "doc_id", b: str = "neighbor_id") -> DataFrame:
    """Both directions of every pair, distinct, without loops: ``src, dst``.

    Pairs with a null end are no edges; an empty table gives no edges.
    """
    p = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    d = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = d.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return d.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    o = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = o.groupBy("src").agg(F.min("dst").alias("m"))
    moved = o.join(low, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(low.select("src", F.col("m").alias("dst"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge; the root is the smallest node of its component.

    Rounds end when a round changes nothing, which a count and a checksum tell;
    only these two numbers reach the driver.
    """
    e = edges.select("src", "dst").where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e, before = materialise(e), None
    while True:
        after = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if after["n"] == 0 or before == tuple(after):
            break
        before = tuple(after)
        following = materialise(_small_star(_large_star(e)))
        discard(e)
        e = following
    return e.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def connected_components(edges: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, cluster_id`` for every node; clusters are numbered from 0 by their smallest member.

    Nodes without edges are clusters of their own; repeated nodes count once;
    null nodes are left out.
    """
    roots = component_roots(edges)
    ids = nodes.select(F.col(id_col).alias("node")).where("node IS NOT NULL").distinct()
    rooted = ids.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return dense_numbers(rooted, "root", "cluster_id").select(F.col("node").alias(id_col), "cluster_id")


def dense_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the dense rank of ``key`` from 0 without sorting all rows in one task.

    The distinct keys are range-partitioned and numbered within partitions; the
    sizes of the partitions, one number each, give the offsets.
    """
    keys = materialise(df.select(key).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    sizes = keys.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    local = keys.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    return df.join(local.join(F.broadcast(offsets), "_p").select(key, (F.col("_o") + F.col("_r")).cast("int").alias(name)), key)


def degrees(edges: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, degree`` for every node, 0 for isolated ones; ``edges`` hold both directions."""
    n = edges.groupBy(F.col("src").alias(id_col)).agg(F.count("*").alias("degree"))
    return nodes.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(n, id_col, "left").select(id_col, F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
