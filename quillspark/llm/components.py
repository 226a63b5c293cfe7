"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, steps: int = 40) -> DataFrame:
    """(a, b) pairs to (node, component), the component being its least node; nodes without an edge are absent.

    Each step halves the depth of the trees, so a few suffice. Every step is checkpointed, so a lost
    executor costs one step at most. Nulls and loops are ignored.
    """
    now = checkpoint(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())
    seen = None
    for _ in range(steps):
        now = checkpoint(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
