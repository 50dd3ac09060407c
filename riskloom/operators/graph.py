"""Graph statistics on an edge table (src, dst), by iterated joins.

Things that share an attribute are linked to the attribute's node, not to each other: a
group of n members costs n edges, never n² pairs. Each round is written to the shared
checkpoint folder, so plans stay short and a lost executor repeats one round only. Messages
to a node are reduced with partial aggregation, so a node with very many edges is no hot
task on the reduce side; on the join side the node table has one row per node and Spark's
skew join splits the many edges of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_c = F.col


def shared_attribute_edges(df: DataFrame, member: str, attribute: str) -> DataFrame:
    """Edges between members and the attribute values they have, with prefixed node names."""
    return df.where(_c(member).isNotNull() & _c(attribute).isNotNull()).select(
        F.concat(F.lit("m:"), _c(member).cast("string")).alias("src"), F.concat(F.lit("a:"), _c(attribute).cast("string")).alias("dst")
    ).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(_c("dst").alias("src"), _c("src").alias("dst"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(_c("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node name of each connected part.

    Every round takes the smallest label among the neighbours and then jumps to the label of
    the label, which halves the distance left; it stops when nothing changes.
    """
    e = cut_lineage(both_ways(edges))
    labels = cut_lineage(e.select(_c("src").alias("node")).distinct().withColumn("label", _c("node")))
    for _ in range(most_rounds):
        near = e.join(labels, _c("src") == _c("node")).groupBy(_c("dst").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", _c("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(_c("node").alias("label"), _c("label").alias("jump"))
        new = cut_lineage(low.join(hop, "label", "left").select("node", "old", F.least("label", "jump").alias("label")))
        changed = new.where(_c("old") != _c("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", _c("label").alias("component"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """PageRank with a fixed number of rounds; ranks sum to the number of nodes."""
    e = cut_lineage(both_ways(edges))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut_lineage(e.join(out, "src"))
    ranks = links.select(_c("src").alias("node")).distinct().withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        got = links.join(ranks, _c("src") == _c("node")).groupBy(_c("dst").alias("node")).agg(F.sum(_c("rank") / _c("out")).alias("in"))
        ranks = cut_lineage(got.select("node", (F.lit(1 - damping) + damping * _c("in")).alias("rank")))
    return ranks


def shortest_path(edges: DataFrame, source: str, most_rounds: int = 100) -> DataFrame:
    """(node, distance) in edges from a source, by widening a frontier."""
    e = cut_lineage(both_ways(edges))
    seen = e.where(_c("src") == source).select(_c("src").alias("node")).distinct().withColumn("distance", F.lit(0))
    front = seen
    for step in range(1, most_rounds + 1):
        nxt = e.join(front, _c("src") == _c("node")).select(_c("dst").alias("node")).distinct()
        front = cut_lineage(nxt.join(seen, "node", "left_anti").withColumn("distance", F.lit(step)))
        if front.limit(1).count() == 0:
            return seen
        seen = cut_lineage(seen.unionByName(front))
    raise RuntimeError(f"frontier still grows after {most_rounds} rounds")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation: a node takes the most frequent label around it, the smallest among
    equals. Votes are counted per (node, label) first."""
    e = cut_lineage(both_ways(edges))
    labels = e.select(_c("src").alias("node")).distinct().withColumn("label", _c("node"))
    for _ in range(rounds):
        votes = e.join(labels, _c("src") == _c("node")).groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(_c("dst").alias("node")).agg(F.min(F.struct((-_c("n")).alias("n"), "label")).alias("b"))
        labels = cut_lineage(best.select("node", _c("b.label").alias("label")))
    return labels.select("node", _c("label").alias("community"))
