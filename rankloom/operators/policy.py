"""Ensembles, cascades and gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def majority(votes: DataFrame, case: str, run: str, answer: str, primary: str) -> DataFrame:
    """(case, answer, votes, n_runs): the answer that most runs give if that is over half, else the primary run's. Ties never have a majority."""
    n = votes.groupBy(case).agg(F.count("*").alias("n_runs"), F.max(F.when(F.col(run) == primary, F.col(answer))).alias("own"))
    by = votes.groupBy(case, answer).agg(F.count("*").alias("votes"))
    best = by.groupBy(case).agg(F.max(F.struct("votes", answer)).alias("best"))
    out = best.join(n, case)
    wins = F.col("best.votes") * 2 > F.col("n_runs")
    return out.select(case, F.when(wins, F.col(f"best.{answer}")).otherwise(F.col("own")).alias(answer), F.col("best.votes").alias("votes"), "n_runs")


def resolve(first: Column, second: Column, adjudicator: Column) -> Column:
    """Agreement stands; else the adjudicator decides, and an acceptance needs one more acceptance; anything missing fails closed."""
    accepts = lambda c: F.coalesce((c == "accept").cast("int"), F.lit(0))
    enough = accepts(first) + accepts(second) + accepts(adjudicator) >= 2
    return F.when(first.isNotNull() & first.eqNullSafe(second), first).when(adjudicator == "accept", F.when(enough, "accept").otherwise("fail_closed")).when(adjudicator.isNotNull(), adjudicator).otherwise("fail_closed")


def gate(baseline: DataFrame, candidate: DataFrame, tolerance: dict[str, float], hard: tuple[str, ...] = ()) -> DataFrame:
    """(metric, baseline, candidate, decision) of two (metric, value) tables: a hard metric that falls, or one that is missing, rejects;
    a soft one that falls by up to twice its tolerance needs review."""
    tol = F.create_map(*[F.lit(x) for kv in tolerance.items() for x in kv])
    both = baseline.select("metric", F.col("value").alias("baseline")).join(candidate.select("metric", F.col("value").alias("candidate")), "metric", "left").where(F.col("metric").isin(list(tolerance)))
    fall = F.col("baseline") - F.col("candidate")
    t = tol[F.col("metric")]
    is_hard = F.col("metric").isin(list(hard)) if hard else F.lit(False)
    decision = F.when(F.col("candidate").isNull(), "REJECT").when(fall <= t, "PROMOTE").when(~is_hard & (fall <= 2 * t), "NEEDS_REVIEW").otherwise("REJECT")
    return both.select("metric", "baseline", "candidate", decision.alias("decision"))


def worst(decisions: DataFrame) -> DataFrame:
    """(decision): the worst of all."""
    rank = F.when(F.col("decision") == "REJECT", 2).when(F.col("decision") == "NEEDS_REVIEW", 1).otherwise(0)
    return decisions.agg(F.max(rank).alias("r")).select(F.when(F.col("r") == 2, "REJECT").when(F.col("r") == 1, "NEEDS_REVIEW").otherwise("PROMOTE").alias("decision"))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("row")).select("row.*")


def shards(requests: DataFrame, order: str, size: Column, max_requests: int, max_size: int, by: str, tokens: Column | None = None, max_tokens: int | None = None) -> DataFrame:
    """(by, order, shard): greedy bins in order, by count, size and, if given, tokens, of each group's requests (one provider file each).

    A shard's end depends on all before it, so a group is one sorted stream; only its running sums are held. A request over a limit on its own is an error.
    """
    rows = requests.select(by, order, size.cast("long").alias("size"), (F.lit(0) if tokens is None else tokens).cast("long").alias("tokens"))
    most = (max_requests, max_size, max_tokens if max_tokens is not None else 1 << 62)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, shard, used = None, 0, [0, 0, 0]
        for batch in batches:
            out = []
            for g, s, t in zip(batch[by], batch["size"], batch["tokens"], strict=True):
                if s > most[1] or t > most[2]:
                    raise ValueError("a request is over a limit on its own")
                if g != group:
                    group, shard, used = g, 0, [0, 0, 0]
                after = [used[0] + 1, used[1] + s, used[2] + t]
                if any(a > m for a, m in zip(after, most, strict=True)):
                    shard, after = shard + 1, [1, s, t]
                used = after
                out.append(shard)
            yield batch[[by, order]].assign(shard=pd.Series(out, index=batch.index, dtype="int32"))

    schema = T.StructType([rows.schema[by], rows.schema[order], T.StructField("shard", T.IntegerType())])
    return rows.repartition(by).sortWithinPartitions(by, order).mapInPandas(deal, schema)
