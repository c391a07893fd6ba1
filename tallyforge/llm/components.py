"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import joined, scratch, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(a, b), two columns of long; root is the smallest node of a node's component.

    Alternates two steps until nothing changes: every node's larger
    neighbours are tied to its smallest neighbour, then its smaller
    neighbours and itself are.  Each step is a minimum by key, summed up
    before the shuffle, and a join; each round is written, so a lost executor
    costs one round.  Null ends and loops are left out.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(spark, now, "edges")
    state = _state(now)
    while state[0]:
        with scratch(spark):
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # written, so that the join reads both sides afresh and can split the rows of a node with very many neighbours
            least = stored(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
            large = joined(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = stored(spark, large, "large")
            least = stored(spark, large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = joined(large, least, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
            now = stored(spark, small, "edges", outer=True)
        new = _state(now)
        if new == state:
            break
        state = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).collect()[0]
    return row.n, row.x
