"""Leader clustering as a maximal independent set.

Taking rows in order of id, a row becomes a leader unless an earlier leader is
similar enough.  The leaders are thus the lexicographically first maximal
independent set of the similarity graph, which rounds over all rows find
together (Blelloch, Fineman and Shun, 2012): a row whose earlier neighbours are
all no leaders leads; a row beside an earlier leader follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .graph import dense_numbers


def leader_clustering(pairs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """``id, cluster_id, leader, similarity`` of every node.

    ``pairs`` holds ``a, b, similarity`` with a < b of all pairs at or above the
    (positive) threshold.  Clusters are numbered by their leaders' order.  A row
    goes to the most similar earlier leader, ties to the earliest; a leader has
    itself and similarity null.  Rows without pairs lead clusters of their own;
    null and repeated ids count once or not at all.
    """
    ids = nodes.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    edges = materialise(pairs.select("a", "b", F.round("similarity", digits).alias("s")))
    open_ = materialise(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct())
    leaders = None
    while open_.limit(1).count():
        inner = edges.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi")
        free = materialise(open_.join(inner.select(F.col("b").alias("id")), "id", "left_anti"))  # no earlier neighbour is undecided
        leaders = free if leaders is None else leaders.union(free)
        beside = edges.join(free.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
        open_ = materialise(open_.join(free, "id", "left_anti").join(beside, "id", "left_anti"))
    if leaders is None:
        leaders = ids.limit(0)
    best = F.min(F.struct((-F.col("s")).alias("m"), F.col("a").alias("leader"))).alias("x")
    followed = edges.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").join(leaders.withColumnRenamed("id", "b"), "b", "left_anti")
    followed = followed.groupBy(F.col("b").alias("id")).agg(best).select("id", F.col("x.leader").alias("leader"), (-F.col("x.m")).alias("similarity"))
    out = ids.join(followed, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"), "similarity")
    return dense_numbers(out, "leader", "cluster_id").select(F.col("id").alias(id_col), "cluster_id", "leader", "similarity")
