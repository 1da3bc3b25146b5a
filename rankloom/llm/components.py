"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stage


def _least(pairs: DataFrame, by: str, of: str) -> DataFrame:
    return pairs.groupBy(F.col(by).alias("__k")).agg(F.min(of).alias("m"))


def _with_least(pairs: DataFrame, by: str, of: str) -> DataFrame:
    return pairs.join(_least(pairs, by, of), F.col(by) == F.col("__k")).drop("__k")


def _mark(edges: DataFrame) -> tuple:
    """Two edge tables with the same count and the same sums of two 64-bit hashes are taken as equal."""
    one, two = F.xxhash64("v", "u").cast("decimal(38,0)"), F.xxhash64(F.lit(7), "u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(one), F.sum(two)).first())


def components(edges: DataFrame, stage: Stage, name: str, rounds: int = 100) -> DataFrame:
    """(a, b) to (node, comp) for every node that has an edge; comp is the component's smallest node.

    Each round rewires the edges towards smaller nodes, with sums before each shuffle, and is written to the shared folder.
    The number of rounds grows with the logarithm of the longest path; it ends when a round changes nothing.
    """
    now = stage.write(f"{name}-0", edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    for i in range(1, rounds + 1):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        # large star: larger neighbours of x go to the least of x and its neighbours
        large = _with_least(both, "x", "y").where("y > x").select(F.col("y").alias("v"), F.least("x", "m").alias("u")).where("v <> u").distinct()
        # small star: x and its smaller neighbours go to the least of them
        small = _with_least(large, "v", "u")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        now = stage.write(f"{name}-{i}", small)
        stage.drop(f"{name}-{i - 1}")
        mark = _mark(now)
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(roots)
