"""What filters remove together: joint-failure counts of all subsets, inverted to survivors, unique failures, redundancy and Shapley shares.

Each document fails some of the filters. For every subset S of them the number of documents that fail all of S, J(S), is a sum of products of flags; one
aggregation gives all 2^n sums of every part. Inclusion and exclusion does the rest, from these sums alone: survivors of S are the sum of (-1)^|T| J(T)
over the subsets T of S, and the dividend of T in the game "documents removed" is (-1)^(|T| + 1) J(T), which the Shapley value shares equally among the members of T.

Copies: a row fails the filter of exact copies if a row with the same text has a smaller id, wherever it is and whatever other filters say of it. Texts are compared
by two digests (sha-256), which never leave their scan: a row of an id, a digest and flags is all that is shuffled, summed before each shuffle, so neither an id, a text, a
part nor a group of copies with a third of all rows lands in one task.

Defined cases: a null text equals the empty text: it has no words, so it is short and not repetitive, not loud, and holds no mark. A null id is neither
smaller nor larger than another; its row is no copy, and has no labels. Repeated rows count each; equal ids are not smaller than one another. A document is good (toxic) if any of its
label rows says quality 1 (toxic 1). A null part is the empty string. An empty table gives no parts and so no rows. Further columns are not read, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations
from math import factorial
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import clean_text, pick, small_batches, tidy
from .kernels import text_buffers, words

FILTERS = "ABCDE"
_MARKS = np.isin(np.arange(256), [ord(c) for c in "#$%&*|"])
_COUNTS = ("n", "good", "toxic")


def text_flags(column: pa.Array) -> dict[str, np.ndarray]:
    """Whether each text is short (A), repetitive (B), loud (C), holds marks (D). The thresholds of the audit. Distinct words are counted by 64-bit hashes."""
    data, offsets = text_buffers(column)
    hashes, _, _, at = words(data, offsets, lower=False)
    count, distinct = np.diff(at), np.zeros(len(offsets) - 1, np.int64)
    for i in np.flatnonzero(count).tolist():
        h = np.sort(hashes[at[i] : at[i + 1]])
        distinct[i] = 1 + np.count_nonzero(h[1:] != h[:-1])
    inside = lambda hit: np.diff(np.searchsorted(np.flatnonzero(hit), offsets))
    capitals = inside((data >= 65) & (data <= 90))
    points = np.diff(offsets) - inside((data & 0xC0) == 0x80)  # bytes that don't begin a character
    return {"A": count < 200, "B": 100 * distinct < 50 * count, "C": 100 * capitals > 3 * points, "D": inside(_MARKS[data]) > 0}


def _flag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = text_flags(batch["text"])
        data, offsets = text_buffers(batch["text"])
        raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
        digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["part"], pa.array(digest, pa.binary()), *[pa.array(f) for f in flags.values()]], ["id", "part", "digest", *flags])


def flagged(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, A to E, good, toxic and n: how many documents have these. At most one row for each text, part and pair of labels."""
    small_batches(docs.sparkSession)
    rows = docs.select(pick(docs, id_col).alias("id"), F.coalesce(pick(docs, part_col).cast("string"), F.lit("")).alias("part"), clean_text(pick(docs, text_col)).alias("text"))
    kinds = dict(rows.dtypes)
    rows = rows.mapInArrow(tidy(_flag_rows), f"id {kinds['id']}, part string, digest binary, A boolean, B boolean, C boolean, D boolean")
    own = [*rows.columns[1:]]
    rows = rows.groupBy("id", *own).agg(F.count("*").alias("n"))  # an id that many rows have is one row a text and part from here on
    marked = lambda c: F.coalesce(F.max(pick(labels, c) == 1), F.lit(False)).alias("toxic" if c == "toxic" else "good")
    marks = labels.groupBy(pick(labels, id_col).alias("id")).agg(marked("quality"), marked("toxic")).where("good or toxic")
    rows = rows.join(marks, "id", "left").fillna(False, ["good", "toxic"])
    # each group below holds an id once, so its first id's count is one row's
    groups = rows.groupBy(*own, "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("of_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    firsts = groups.groupBy("digest").agg(F.min("first").alias("smallest"))
    groups = groups.join(firsts, "digest")
    originals = F.col("unnamed") + F.when(F.col("first") == F.col("smallest"), F.col("of_first")).otherwise(0)
    either = F.array(F.struct(F.lit(False).alias("E"), originals.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - originals).alias("n")))
    return groups.select("part", *"ABCD", "good", "toxic", F.explode(either).alias("e")).select("part", *"ABCD", "e.E", "good", "toxic", "e.n").where("n > 0")


def joint_failures(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """part and, for all documents, the good and the toxic ones, the array of joint-failure counts: entry m is the number that fail all filters of the bits of m."""
    patterns = rows.groupBy("part", *filters, "good", "toxic").agg(F.sum("n").alias("n"))  # 4 * 2^n rows a part at most
    masks = F.array(*[F.lit(m) for m in range(1 << len(filters))])
    # a subset's product of flags: all its flags hold
    product = reduce(and_, [F.col(f) | ~F.col("m").bitwiseAND(F.lit(1 << i)).cast("boolean") for i, f in enumerate(filters)])
    weights = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    sums = patterns.withColumn("m", F.explode(masks)).groupBy("part", "m").agg(*[F.sum(product.cast("int") * w).alias(k) for k, w in weights.items()])
    return sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("m", *weights))).alias("s")).select("part", *[F.col(f"s.{k}").alias(k) for k in weights])


def _signed(mask: Column, size: int) -> Column:
    """(-1) to the number of bits of a subset."""
    return F.when(F.bit_count(mask) % 2 == 0, 1).otherwise(-1)


def _inverted(joint: str, size: int) -> Column:
    """Survivors of every subset, by Moebius inversion of the joint-failure counts."""
    masks = F.array(*[F.lit(m) for m in range(1 << size)])
    add = lambda s: lambda total, t: total + F.when(t.bitwiseAND(s) == t, _signed(t, size) * F.element_at(joint, t + 1)).otherwise(0)
    return F.transform(masks, lambda s: F.aggregate(masks, F.lit(0).cast("long"), add(s)))


def audit(joint: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    All from the joint-failure counts; shapley is the Shapley value times the number of orders, so it is whole.
    """
    size, everything = len(filters), (1 << len(filters)) - 1
    masks = F.array(*[F.lit(m) for m in range(1 << size)])
    own = joint.select("part", F.col("n").alias("joint"), *[_inverted(k, size).alias(k) for k in _COUNTS])
    orders = "".join(filters), size
    steps = F.explode(F.from_json(F.lit(_steps_json(*orders)), "array<struct<o:string,s:int,f:int,b:int>>")).alias("at")
    rows = own.select("*", steps).select("*", "at.*").drop("at")
    bit = F.expr("shiftleft(1, f)")
    after = F.col("b").bitwiseOR(bit)
    at = lambda c, m: F.element_at(c, m + 1)
    removed = lambda c: at(c, F.col("b")) - at(c, after)
    holding = F.filter(masks, lambda t: t.bitwiseAND(bit) != 0)
    fails = at("joint", bit)
    share = lambda t: -_signed(t, size) * at("joint", t)  # noqa: E731  the dividend of a subset
    total = lambda f: F.aggregate(holding, F.lit(0).cast("long"), lambda acc, t: acc + f(t))
    per_member = F.array(*[F.lit(factorial(size) // max(k, 1)) for k in range(size + 1)])  # each member's part of a dividend, times the number of orders
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), at("n", after).alias("kept"), removed("n").alias("removed"), (fails - removed("n")).alias("redundant"),
        (at("n", F.lit(everything).bitwiseAND(F.bitwise_not(bit))) - at("n", F.lit(everything))).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), total(lambda t: share(t) * F.element_at(per_member, F.bit_count(t) + 1)).cast("long").alias("shapley"),
    )


def _steps_json(names: str, size: int) -> str:
    """Each step of each order: the order's name, the step from 1, its filter's bit and the subset of the filters before it."""
    out = []
    for order in permutations(range(size)):
        before = 0
        for k, f in enumerate(order):
            out.append({"o": "".join(names[i] for i in order), "s": k + 1, "f": f, "b": before})
            before |= 1 << f
    return json.dumps(out)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(joint_failures(flagged(docs, labels)))


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
    100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS C, regexp_matches(body, '[#$%&*|]') AS D, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY body), false) AS E
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
fails AS (
  SELECT part, CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END AS failed,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM names a, names b, names c, names d, names e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, step, filter_order[step] AS x, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
rows AS (
  SELECT part, filter_order, step::INT AS step, x,
    coalesce(sum(n) FILTER (translate(failed, earlier || x, '') = failed), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(failed, x) AND translate(failed, earlier, '') <> failed), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = x), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0)::BIGINT AS toxic_lost
  FROM fails, steps GROUP BY part, filter_order, step, x)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM rows
"""
