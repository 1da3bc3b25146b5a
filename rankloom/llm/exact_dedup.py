"""Exact deduplication as a stateful stream with disk-backed keyed state that never expires.

The rows' digests, with id and content locator (file and row index), go to a log in the shared folder. A stream over the log keeps, for
each digest, the smallest id, its locator and a count in RocksDB state: no watermark, so nothing expires. With a `state` folder a later run goes on from what
earlier ones have kept: its documents meet theirs, its report has its own rows only, and the row that stays is the smallest of all runs so far. Without one, the state is deleted
with the run's other tables. Every hit is then checked against the full bytes at its group's locator; rows whose bytes differ although
the digests agree are grouped by their bytes instead. A hashed bitmap of bounded size keeps all other texts in their scan. DataFrame operators only.

A digest that a third of all rows share is summed before it is shuffled, and its rows meet the group's one kept row in
salted parts of about 1 / PARTS of all rows.

Defined cases: a null text equals the empty text. Texts are compared whole, however long, after each run of ASCII white space became one space. Ties
in the id (repeated rows) go to the smaller locator, so one of them is kept. A null id counts as larger than all others. Empty input, empty result.
Further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOCATOR, WS, Stage, clean_text, may_be_in, pick, settled, there, with_locator

#: A group of more than 1 / PARTS of all rows meets its rows in parts.
PARTS = 1000
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def normal(text: Column) -> Column:
    return F.regexp_replace(clean_text(text), WS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keep_state(spark: SparkSession, log_path: str, log: DataFrame, stage: Stage | None, files_per_batch: int = 4096) -> DataFrame:
    """(digest, first, n) after the whole log has gone through the stateful stream; `first` orders by id, then locator. Without a stage the state lasts beside the log."""
    out, state = f"{log_path}-state", f"{log_path}-progress"
    if stage is not None:
        stage.adopt("state", out)
        stage.adopt("progress", state)
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
        state_rows = stream.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", LOCATOR)).alias("first"), F.count("*").alias("n"))

        def changed(batch: DataFrame, number: int) -> None:
            batch.withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number}")

        query = state_rows.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state_rows.withColumn("at", F.lit(0)).schema
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out) if there(spark, out) else spark.createDataFrame([], schema)
    if query.lastProgress and query.lastProgress["batchId"] == 0:
        return changes.drop("at")
    return changes.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "at").alias("last")).select("digest", "last.first", "last.n")


def _earlier_texts(spark: SparkSession, state: str, groups: DataFrame, log: DataFrame) -> DataFrame:
    """(digest, keep_body) of groups whose kept row came in an earlier run, read again from where it lies."""
    gone = groups.join(log.select(F.col(LOCATOR).alias("keep_at")), "keep_at", "left_anti").withColumn("file", F.substring_index("keep_at", "#", 1))
    files = spark.read.parquet(f"{state}/files").distinct().join(gone.select("file").distinct(), "file", "left_semi").groupBy("path", "id_name", "text_name").agg(F.first("file").alias("file"))
    out = None
    for names, paths in _by_names(files).items():
        old = spark.read.parquet(*paths)
        rows = with_locator(old, [pick(old, names[1]).cast("string").alias("text")])
        found = rows.join(gone.select("digest", "keep_at"), F.col(LOCATOR) == F.col("keep_at")).select("digest", normal(F.col("text")).alias("keep_body"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else gone.select("digest", F.lit(None).cast("string").alias("keep_body")).limit(0)


def _by_names(files: DataFrame) -> dict[tuple[str, str], list[str]]:
    """The paths of input files (Spark's driver lists them to read them) by the names of their columns."""
    out: dict[tuple[str, str], list[str]] = {}
    for r in files.toLocalIterator():
        out.setdefault((r.id_name, r.text_name), []).append(r.path)
    return out


def _lasting(docs: DataFrame, state: str) -> DataFrame:
    """`docs`, if its rows lie in files, else a copy beside the state: a later run must be able to read a kept row again."""
    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        path = f"{state}/rows-{uuid4().hex}"
        docs.write.parquet(path)
        return docs.sparkSession.read.schema(docs.schema).parquet(path)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 4096, state: str | None = None) -> DataFrame:
    """A row for each input row: its locator, id, keep_id, group_size, kept and text_sha256. `state`: a shared folder that this run goes on from and leaves for the next."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "exact")
    docs = _lasting(docs, state) if state else docs
    key, text = pick(docs, id_col), pick(docs, text_col)
    placed = with_locator(docs, [key.alias("id"), text.cast("string").alias("text")], stage)
    body = normal(F.col("text"))
    log = stage.write("log", placed.select(LOCATOR, "id", digest(body).alias("digest"), sha256(body).alias("text_sha256") if digest is not sha256 else F.lit(None).cast("string").alias("text_sha256")))
    if state:
        log.write.mode("append").parquet(f"{state}/log")
        places = docs.select(F.hex(F.xxhash64("_metadata.file_path")).alias("file"), F.col("_metadata.file_path").alias("path"), F.lit(id_col).alias("id_name"), F.lit(text_col).alias("text_name")).distinct()
        places.write.mode("append").parquet(f"{state}/files")
        held = keep_state(spark, f"{state}/log", log, None, files_per_batch)
    else:
        held = keep_state(spark, stage.paths["log"], log, stage, files_per_batch)
    groups = stage.write("groups", held.where("n > 1"))
    stage.drop("state", "progress")
    groups = groups.select("digest", "n", F.col("first.id").alias("keep_id"), F.col(f"first.{LOCATOR}").alias("keep_at"))
    # groups of more than 1 / PARTS of all rows, PARTS at most, meet their rows in parts; a row's part follows from its locator
    share = F.lit(max(log.count(), 1) / PARTS)
    large = groups.where(F.col("n") > share).select(F.col("digest").alias("d"), F.ceil(F.col("n") / share).cast("int").alias("salts"))
    in_parts = lambda rows: rows.join(F.broadcast(large), F.col("digest") == F.col("d"), "left").drop("d").withColumn("salts", F.coalesce("salts", F.lit(1)))
    parts = stage.write("parts", in_parts(groups).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))
    members = in_parts(log).withColumn("salt", F.pmod(F.xxhash64(LOCATOR), F.col("salts")).cast("int")).drop("salts")
    members = stage.write("members", members.join(parts, ["digest", "salt"], "left"))
    stage.drop(*([] if state else ["log", "groups"]))  # with a state, earlier texts are found by them
    # full bytes of hits and of what they hit
    hits = stage.write("hits", members.where("keep_at is not null").select(F.col(LOCATOR).alias("at"), "digest", "salt", "keep_at"))
    texts = may_be_in(placed.select(LOCATOR, "text"), LOCATOR, hits, stage, "hit-filter").where("__may").drop("__may")
    texts = stage.write("texts", texts.join(hits, F.col(LOCATOR) == F.col("at")).select("at", "digest", "salt", "keep_at", body.alias("body")))
    kept = texts.where("at = keep_at").select("digest", F.col("body").alias("keep_body"))
    if state:
        kept = kept.unionByName(_earlier_texts(spark, state, groups, log))
    kept = kept.join(parts.select("digest", "salt"), "digest")
    differ = texts.where("at <> keep_at").join(kept, ["digest", "salt"]).where(F.col("body") != F.col("keep_body")).select("at", "digest", "body")
    differ = stage.write("differ", differ)
    stage.drop("texts", "hits", "hit-filter", "parts")
    out = members
    if not differ.isEmpty():  # equal digests of different bytes: group these rows by their bytes
        own = differ.join(members.select(F.col(LOCATOR).alias("at"), "id"), "at")
        first = own.groupBy("digest", "body").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"), F.count("*").alias("m"))
        apart = own.join(first, ["digest", "body"]).select(F.col("at").alias(LOCATOR), F.col("first.id").alias("own_keep"), F.col("first.at").alias("own_at"), "m")
        fewer = differ.groupBy("digest").agg(F.count("*").alias("less"))
        out = out.join(apart, LOCATOR, "left").join(fewer, "digest", "left")
        moved = F.col("m").isNotNull()
        out = out.withColumn("n", F.when(moved, F.col("m")).otherwise(F.col("n") - F.coalesce("less", F.lit(0))))
        out = out.withColumn("keep_id", F.when(moved, F.col("own_keep")).otherwise(F.col("keep_id"))).withColumn("keep_at", F.when(moved, F.col("own_at")).otherwise(F.col("keep_at")))
    alone = F.col("keep_at").isNull()
    return out.select(
        LOCATOR, F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_at") == F.col(LOCATOR))).alias("kept"), F.coalesce("text_sha256", "digest").alias("text_sha256"),
    )


def report(docs: DataFrame, **columns: str) -> DataFrame:
    return decide(docs, **columns).drop(LOCATOR)


def drop_rows(docs: DataFrame, dropped: DataFrame, stage: Stage) -> DataFrame:
    """The rows of `docs`, which must be settled, but those at the locators of `dropped`."""
    dropped = stage.write("dropped", dropped.select(LOCATOR))
    rows = may_be_in(with_locator(docs), LOCATOR, dropped, stage, "drop-filter")
    kept = rows.where("not __may").unionByName(rows.where("__may").join(dropped, LOCATOR, "left_anti"))
    return kept.select(*[pick(kept, c) for c in docs.columns])


def filter_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """`docs` without the rows whose text another row already has."""
    docs = settled(docs)
    return drop_rows(docs, decide(docs, **columns).where("not kept"), Stage(docs.sparkSession, "exact-rows"))


REPORT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
