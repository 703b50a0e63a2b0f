"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.scratch import materialize


#: Neighbours of a node from which on its edges are dealt to several tasks, so many to each.
HOT = 100_000


def _large_star(edges: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    out = _met(both, "a", least, hot).where("b > a")
    return out.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
    out = _met(edges, "b", least, hot)
    links = out.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return links.where("a < b").distinct()


def _met(edges: DataFrame, node: str, least: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``edges`` with ``m`` of their ``node``. hot: nodes with many edges and the parts theirs are dealt to."""
    if hot is None:
        return edges.join(least, F.col(node) == F.col("u"))
    h = F.broadcast(hot)
    dealt = edges.join(h, F.col(node) == F.col("hot"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("parts")), F.lit(0))).drop("hot", "parts")
    copies = least.join(h, F.col("u") == F.col("hot"), "left").withColumn("of_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    return dealt.join(copies, (F.col(node) == F.col("u")) & (F.col("part") == F.col("of_part")))


def _hot(edges: DataFrame) -> DataFrame | None:
    """Nodes with over ``HOT`` edges: at most two for every ``HOT`` edges, which bounds the broadcast."""
    ends = edges.select(F.col("a").alias("hot")).union(edges.select(F.col("b").alias("hot")))
    counts = ends.groupBy("hot").count().where(F.col("count") > HOT).select("hot", F.ceil(F.col("count") / HOT).alias("parts"))
    counts = materialize(counts, "hot-nodes")
    return counts if counts.limit(1).count() else None


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component.

    ``edges`` has two columns a < b of one type. Every step is joins and aggregations on the edges; each round's
    edges are written to the shared folder. It ends when a round changes nothing, after a number of rounds that
    grows with the logarithm of the longest path. A node with very many edges is dealt to several tasks. Without edges the result is empty.
    """
    state = materialize(edges.where("a < b").distinct(), "edges")
    mark = None
    while True:
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        hot = _hot(state) if seen[0] > HOT else None
        stars = _large_star(state, hot)
        if hot is not None:
            stars = materialize(stars, "stars")
            hot = _hot(stars)
        state = materialize(_small_star(stars, hot), "edges")
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
