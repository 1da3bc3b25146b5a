"""Mixing sources to target weights by capped water-filling.

Sources share the corpus's words by weight. A source whose share is over `max_epochs` times its own words is clamped
there and what is over goes to the others by weight, until none is above. With sources sorted by cap over weight, the clamped ones are a prefix,
so prefix sums over the table of sources give the level at once. A source then takes every document
floor(target / size) times, and once more the documents that come first in a seeded hash order up to the rest.

The hash order is cut in two steps: sums over hash buckets find the bucket where a source's rest ends, and only that bucket
is sorted, so no task sorts a source. The table of sources (a row each) is what one task sees.

Defined cases: sizes of null or empty texts are 0, and such rows take 0. Null is a source of its own, last in order. A null weight list means 1, 2, 3,
repeating in code point order. Repeated rows count each; rows that tie in id and size are taken alike. Empty input, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, Stage, pick

SEED = "mix-1"
#: Hash buckets of a source: a source's largest sort is its rows over this.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); one row a source in and out."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = sources.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (nth + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything))
    w = w.withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("left_words") / F.col("left_weight"))
    # the level is the first, in this order, that its source's cap can hold
    w = w.withColumn("fits", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("fits").isNull() | (F.col("fits") > F.col("ratio")), F.col("cap").cast("double")).otherwise(F.col("fits") * F.col("weight"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def hash_key(id_column: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.lit(""))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED, keep_columns: bool = False) -> DataFrame:
    """id, size, source_size, target, taken for each row; with `keep_columns` after the input's own columns.

    Then an input column named like a result column (in either case) is left out for the result's.
    """
    key = pick(docs, id_col)
    h = hash_key(key, seed)
    thin = [key.alias(id_col), word_count(pick(docs, text_col)).alias("size"), pick(docs, source_col).cast("string").alias("__source"), h.alias("__h")]
    # id, size, source and hash of each row, without its text
    rows = Stage(docs.sparkSession, "mix").write("thin", docs.select(*thin)).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    sums = rows.groupBy("__source", "__b").agg(F.sum("size").alias("words"))  # map-side sums first: a row for each bucket and task is shuffled
    targets = water_fill(sums.groupBy(F.col("__source").alias("source")).agg(F.sum("words").cast("long").alias("source_size")), max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("__source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = cut.join(targets, cut["__source"].eqNullSafe(targets["source"])).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    cut = cut.select(F.col("__source").alias("source"), F.col("__b").alias("b"), "before", "rest")  # the bucket of each source where its rest ends
    near = rows.join(cut, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__b") == F.col("b")))
    near = near.groupBy("source", "before", "rest", "__h", id_col, "size").agg(F.sum("size").alias("alike"))
    fine = Window.partitionBy("source").orderBy("__h", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("middle", F.col("before") + F.coalesce(F.sum("alike").over(fine), F.lit(0)) + F.col("alike") / 2)
    ends = near.where(F.col("middle") <= F.col("rest")).groupBy(F.col("source").alias("s")).agg(F.max(F.struct("__h", id_col, "size")).alias("last"))
    cut = cut.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "b", "last")
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(F.struct("source").alias("__key"), "source_size", "target", "whole", "b", "last")
    if keep_columns:
        names = {"size", "source_size", "target", "taken"}
        own = [c for c in docs.columns if c.lower() not in names]
        rows = docs.select(F.struct(*[pick(docs, c).alias(c) for c in own]).alias("__own"), *thin).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    shown = ["__own.*"] if keep_columns else [id_col]
    joined = rows.join(plan, F.struct(F.col("__source").alias("source")) == F.col("__key"))  # on one row a source
    first = F.struct("__h", id_col, "size") <= F.col("last")
    extra = F.when(F.col("b").isNull(), False).when(F.col("__b") == F.col("b"), F.coalesce(first, F.lit(False))).otherwise(F.col("__b") < F.col("b"))
    return joined.select(*shown, "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra.cast("long"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows and columns of `mix(keep_columns=True)` and `epoch`, a row for each time that a row is taken (1, 2, ...).

    An input column named epoch is left out for the result's.
    """
    rows = mix(docs, keep_columns=True, **how).where("taken > 0")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))))


#: The same in DuckDB's SQL, for documents under any name: one running sum over each source in hash order.
MIX_SQL = r"""
WITH rows AS (
  SELECT {own}, doc_id AS id_, source AS source_, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h_,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}),
src AS (SELECT source_, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source_),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source_ NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM src),
w2 AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM w),
w3 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS DOUBLE)
                 / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS DOUBLE) AS level
       FROM w2 WINDOW p AS (ORDER BY ratio, source_ NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w4 AS (SELECT *, (SELECT level FROM w3 WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS fits FROM w3),
t AS (SELECT source_, source_size, CASE WHEN fits IS NULL OR fits > ratio THEN CAST(cap AS DOUBLE) ELSE fits * weight END AS target FROM w4),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT rows.*, source_size, target, whole, target - whole * source_size AS rest,
             sum(size) OVER (PARTITION BY rows.source_ ORDER BY h_, id_, size) - sum(size) OVER (PARTITION BY rows.source_, h_, id_, size) / 2.0 AS middle_
      FROM rows JOIN t2 ON rows.source_ IS NOT DISTINCT FROM t2.source_)
SELECT {own}, size, source_size, target,
       CAST(size * (whole + CASE WHEN middle_ <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
