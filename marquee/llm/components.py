"""Connected components of an edge table by alternating star steps, one written table a round."""
from pyspark.sql import DataFrame, functions as F

from ..operators.staging import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): smallest node reachable, for every node of ``edges`` (a, b); nodes of any orderable type.

    Large-star, then small-star steps until nothing changes. Neighbours of a node are only ever reduced by a minimum
    and joined back; adaptive skew joins split a node with very many of them. Logarithmically many rounds are needed;
    a run that is not done after ``rounds`` raises.
    """
    current = staged(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        # small star: every node's smaller neighbours and the node itself meet at the smallest of them
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        current = large.join(smallest, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x != y").distinct().select(
            F.col("x").alias("a"), F.col("y").alias("b"))
        current = staged(current, "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(
        current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct().join(
            current.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
