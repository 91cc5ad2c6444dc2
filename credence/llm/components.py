"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import drop_files, materialize


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: link each larger neighbour to the least of the neighbourhood;
    small: the same for the smaller neighbours and the node itself."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges
    least = (both.groupBy("u").agg(F.min("v").alias("m"))
             .select((-F.col("u")).alias("key"), F.least("m", "u").alias("m")))
    joined = both.withColumn("key", -F.col("u")).join(least, "key")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select((-F.col("key")).alias("u"), F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node but the component's own least node.

    `links` is a table of undirected links between long ids, self links and repeats allowed.
    The component is the least node that can be reached. Rounds go on until the links no longer
    change, which takes about log squared of the longest chain's length. The join of a round is dealt anew
    by the negated node, so Spark may split the edges of a node with very many links.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    seen = _checksum(edges)
    while seen[0]:
        narrow = materialize(_stars(_stars(edges, large=True), large=False), "edges")
        drop_files(edges)
        edges, last = narrow, seen
        seen = _checksum(edges)
        if seen == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
