"""Connected components of a link table, by alternating star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in ``links`` (a, b: long, not null).

    Each round hooks every node's higher neighbours to its lowest one, then its lower ones. Minima are summed
    before they move, and links are joined by keys, so that a node with very many links can be split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, seen = materialize(edges), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == seen:
            break
        seen = state
        ends = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        lowest = ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = edges.join(lowest, edges["lo"] == lowest["u"]).select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(least, large["hi"] == least["u"]).select("hi", "lo", "m")
        hooked = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(hooked.union(small.select("hi", F.col("m").alias("lo"))).distinct())
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(edges.select("lo", "lo").distinct())
