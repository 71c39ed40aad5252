"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for each id on an edge (columns ``a``, ``b``): the least id it is connected to.

    Each round sends every node's neighbours to the least of them and cuts the
    lineage with a written table; the rounds needed grow with the logarithm of the
    longest path. Rows with a null end and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, state = cut(spark, now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node go to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below go to the least of those.
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(below.select("a", F.col("m").alias("b"))).distinct()
        then = cut(spark, small, "edges")
        r = then.agg(F.count(F.lit(1)), F.sum("a").cast("string"), F.sum("b").cast("string"), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(spark, now)
        now = then
        if tuple(r) == state:
            break
        state = tuple(r)
    root = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())
