"""Batches of model calls over their life: requests, attempts, replays, runs bound to an identity, and hash-chained ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_sha256
from . import policy
from .metrics import numbered

#: A provider file's limits, and a ledger's first event.
MAX_REQUESTS, MAX_BYTES, MAX_TOKENS = 50_000, 190_000_000, 1_000_000
FIRST_EVENT = "ledger_initialized"


def ensure(rows: DataFrame, test: Column, message: str) -> DataFrame:
    """The rows, failing where a test does not hold."""
    return rows.where(F.when(F.coalesce(test, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message))))


def unique(rows: DataFrame, key: str, message: str) -> DataFrame:
    """The rows, failing if a key comes twice."""
    n = rows.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    return ensure(rows.join(n, F.col(key).eqNullSafe(F.col("__k"))), F.col("__n") == 1, message).drop("__k", "__n")


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests (file, custom_id, method, url, model, ...): ids are there and single, the method is POST, a file has one endpoint and one model."""
    rows = ensure(requests, F.coalesce("custom_id", F.lit("")) != "", "a request has no custom_id")
    rows = ensure(rows, (F.col("method") == "POST") & F.col("model").isNotNull(), "a request's method or model is invalid")
    one = rows.groupBy(F.col("file").alias("__f")).agg(F.count_distinct("url").alias("__u"), F.count_distinct("model").alias("__m"))
    rows = ensure(rows.join(one, F.col("file") == F.col("__f")), (F.col("__u") <= 1) & (F.col("__m") == 1), "a file mixes endpoints or models").drop("__f", "__u", "__m")
    return unique(rows, "custom_id", "a custom_id comes twice")


def sharded(requests: DataFrame, order: str, size: Column, tokens: Column) -> DataFrame:
    """(file, order, shard) of checked requests within a provider's limits."""
    return policy.shards(checked_requests(requests), order, size, MAX_REQUESTS, MAX_BYTES, "file", tokens, MAX_TOKENS)


def indexed(output: DataFrame, errors: DataFrame) -> DataFrame:
    """(custom_id, source, body) of a provider's rows in any order; an id that is missing or comes twice is an error."""
    rows = output.select("custom_id", F.lit("output").alias("source"), "body").unionByName(errors.select("custom_id", F.lit("error").alias("source"), "body"))
    return unique(ensure(rows, F.coalesce("custom_id", F.lit("")) != "", "a row has no custom_id"), "custom_id", "a result comes twice")


def output_text(body: Column) -> Column:
    """The text of a response body (JSON): all output texts of its messages; an incomplete response, or one without text, is an error."""
    parsed = F.from_json(body, "status string, output array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    said = F.flatten(F.transform(F.filter(F.coalesce(parsed["output"], F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string>>>>")), lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.transform(F.filter(said, lambda c: (c["type"] == "output_text") & c["text"].isNotNull()), lambda c: c["text"])
    done = parsed["status"].isNull() | (parsed["status"] == "completed")
    return F.when(~done, F.raise_error(F.concat(F.lit("response status is "), parsed["status"]))).when(F.size(texts) == 0, F.raise_error(F.lit("response contains no output text"))).otherwise(F.array_join(texts, ""))


def final_attempts(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """(custom_id, attempt, valid, output, attempts) for each request: its last valid attempt, else the last, else none, which is not valid. An attempt at an unknown id is an error."""
    if not attempts.join(requests.select("custom_id"), "custom_id", "left_anti").isEmpty():
        raise ValueError("a result for an unknown custom_id")
    best = attempts.groupBy("custom_id").agg(F.max_by(F.struct("attempt", "valid", "output"), F.struct("valid", "attempt")).alias("b"), F.count("*").alias("attempts"))
    return requests.select("custom_id").join(best, "custom_id", "left").select("custom_id", "b.attempt", F.coalesce("b.valid", F.lit(False)).alias("valid"), "b.output", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def to_retry(final: DataFrame) -> DataFrame:
    return final.where(~F.col("valid")).select("custom_id")


def pending(batches: DataFrame, history: DataFrame, identity: str, retry_invalid: bool = False) -> DataFrame:
    """The batches (batch_id, ...) that a resumed run still has to do: without a record, or, if wished, with an invalid last one. A record of another identity is an error."""
    rows = ensure(history, F.col("identity") == identity, "a record of another run")
    last = rows.groupBy("batch_id").agg(F.max_by("valid", "sequence").alias("__v"))
    done = last.where("__v") if retry_invalid else last
    return batches.join(done.select("batch_id"), "batch_id", "left_anti")


def in_order(records: DataFrame, batches: DataFrame, position: str) -> DataFrame:
    """Records that came in any order, in that of the batches; a batch without a record is an error."""
    rows = batches.select("batch_id", position).join(records.withColumn("__there", F.lit(True)), "batch_id", "left")
    return ensure(rows, F.col("__there"), "a batch has no record").drop("__there").orderBy(position)


def replayed(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last record of each key."""
    return policy.latest(log, key, sequence)


def event_sha256(events: DataFrame, digest: str = "event_sha256") -> Column:
    """An event's digest: of its other fields as canonical JSON."""
    return canonical_sha256({c: F.col(c) for c in events.columns if c != digest})


def chained(events: DataFrame, start: int = 0, previous: str | None = None) -> DataFrame:
    """New events (no sequence, no digests), in the order of their `at`, as the next links of a ledger whose last has sequence start - 1 and digest `previous`.

    A link's digest depends on the one before, so a ledger is one ordered fold over what is appended: new events only.
    """
    import hashlib
    import json

    import pandas as pd
    from pyspark.sql import types as T

    fields = [c for c in events.columns if c != "at"]
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in fields], T.StructField("sequence", T.LongType()), T.StructField("previous_event_sha256", T.StringType()), T.StructField("event_sha256", T.StringType())])

    def link(batches):
        n, before = start, previous
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                event = {c: row[c] for c in fields} | {"sequence": n, "previous_event_sha256": before}
                before = hashlib.sha256(json.dumps(event, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
                out.append(event | {"event_sha256": before})
                n += 1
            yield pd.DataFrame(out, columns=schema.names)

    rows = events.select(*[F.col(c).cast("string").alias(c) for c in fields], "at")
    return rows.repartition(1).sortWithinPartitions("at").mapInPandas(link, schema)


def ledger_faults(events: DataFrame, ledger: str | None = None) -> DataFrame:
    """([ledger,] n, broken_sequence, broken_links, broken_digests, bad_start): sequences count from 0, each event names the digest before it and has its own digest right, and the first opens the ledger."""
    by = [ledger] if ledger else []
    # a ledger's events meet the ones before them by their places, so that a large ledger is no single task
    rows = numbered(events.withColumn("__own", event_sha256(events.drop(*by))), F.col("sequence"), "__place", by)
    before = rows.select(*by, (F.col("__place") + 1).alias("__place"), F.col("event_sha256").alias("__before"))
    rows = rows.join(before, [*by, "__place"], "left")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("sequence") != F.col("__place")).alias("broken_sequence"), F.count_if(~F.col("previous_event_sha256").eqNullSafe(F.col("__before"))).alias("broken_links"),
        F.count_if(F.col("__own") != F.col("event_sha256")).alias("broken_digests"), F.count_if((F.col("__place") == 0) & (F.col("event_type") != FIRST_EVENT)).alias("bad_start"),
    )
