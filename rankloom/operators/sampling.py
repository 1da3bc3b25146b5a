"""Seeded, order-independent samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(id_column: Column, seed: str = "") -> Column:
    return F.sha2(F.concat(F.lit(seed), id_column.cast("string")), 256)


def hash_sample(rows: DataFrame, n: int, key: str, seed: str = "") -> DataFrame:
    """The first n by (hash, id): a top-n, each task keeps n rows at most."""
    return rows.orderBy(order_key(F.col(key), seed), key).limit(n)


def hash_window(rows: DataFrame, offset: int, n: int, key: str, seed: str, by: list[str] | None = None) -> DataFrame:
    """Places offset to offset + n of the hash order, in each group if groups are given; windows of other offsets share no row."""
    w = Window.partitionBy(*(by or [])).orderBy(order_key(F.col(key), seed), key)
    return rows.withColumn("__place", F.row_number().over(w)).where((F.col("__place") > offset) & (F.col("__place") <= offset + n)).drop("__place")


def stratified(rows: DataFrame, stratum: Column, targets: dict[str, int], key: str, seed: str) -> DataFrame:
    """The first `targets` rows of each stratum in an order seeded by seed and stratum."""
    r = rows.withColumn("stratum", stratum).where(F.col("stratum").isin(list(targets)))
    w = Window.partitionBy("stratum").orderBy(F.sha2(F.concat(F.lit(seed), F.col("stratum"), F.lit(":"), F.col(key).cast("string")), 256), key)
    limit = F.create_map(*[F.lit(x) for t in targets.items() for x in t])[F.col("stratum")]
    return r.withColumn("place", F.row_number().over(w)).where((F.col("place") <= max(targets.values())) & (F.col("place") <= limit))


def hash_rate(id_column: Column, rate: float) -> Column:
    """Whether the id's hash, as a fraction, is under the rate."""
    return F.conv(F.substring(F.sha2(id_column.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0 < rate


def holdout(rows: DataFrame, key: str, seed: str, share: float = 0.2) -> DataFrame:
    """`partition` is confirmation for the first share (rounded half to even, one at least) of the hash order, else development.

    Counts by the hash's first digits find the bucket where the share ends; only that bucket is ranked.
    """
    keyed = rows.withColumn("__h", order_key(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, 4))
    counts = keyed.groupBy("__b").agg(F.count("*").alias("n"))  # 65,536 rows at most
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    take = F.greatest(F.lit(1), F.bround(share * F.sum("n").over(total), 0).cast("long"))
    cut = counts.select("__b", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), take.alias("take"))
    cut = cut.where((F.col("before") < F.col("take")) & (F.col("before") + F.col("n") >= F.col("take"))).select(F.col("__b").alias("cut"), "before", "take")
    near = keyed.join(F.broadcast(cut), F.col("__b") == F.col("cut"))  # one row
    place = F.row_number().over(Window.partitionBy("cut").orderBy("__h", key)) + F.col("before")
    last = near.withColumn("place", place).where(F.col("place") <= F.col("take")).agg(F.max(F.struct("__h", F.col(key).alias("k"))).alias("last"))
    inside = F.struct("__h", F.col(key).alias("k")) <= F.col("last")
    return keyed.crossJoin(F.broadcast(last)).withColumn("partition", F.when(inside, "confirmation").otherwise("development")).drop("__h", "__b", "last")
