"""Service telemetry as a stream: windowed counts with a watermark for late events, and an idempotent latest-record sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import new_path


def windowed(events: DataFrame, width: str, lateness: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total, highest) by event time; events later than the watermark are left out of closed windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"))


def _source(path: str) -> str:
    return path[:-1] + "[" + path[-1] + "]"  # as a pattern the source takes a single file as well as a folder


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, last, before): of each file of events its first and last time, and the last time of the files that came before it, by modification time, then path."""
    rows = spark.read.parquet(path).select(F.col("ts").cast("timestamp").alias("ts"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    files = rows.groupBy("file", "at").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    order = Window.orderBy("at", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, which the driver lists anyway
    return files.select("file", "first", "last", F.max("last").over(order).alias("before"))


def disorder(spark: SparkSession, path: str) -> float:
    """The least lateness, in seconds, by which no event of the files in their order is late: how far a file's events go back behind those before it."""
    behind = F.max(F.unix_micros("before") - F.unix_micros("first"))
    return max(arrivals(spark, path).agg(behind.alias("n")).first().n or 0, 0) / 1e6


def late_events(spark: SparkSession, path: str, width: str, lateness: str) -> DataFrame:
    """The side output of a run that takes a file a batch: events whose window had closed, by the watermark of the files before, when they came."""
    events = spark.read.parquet(path)
    rows = events.select("*", F.col("_metadata.file_path").alias("__file")).join(F.broadcast(arrivals(spark, path).select(F.col("file").alias("__file"), "before")), "__file")  # a row a file
    closed = F.window(F.col("ts").cast("timestamp"), width)["end"] <= F.col("before") - F.expr(f"interval {lateness}")
    return rows.where(closed).select(*events.columns)


def run_windows(spark: SparkSession, path: str, width: str, lateness: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Drain the table's files as a stream into the shared folder; the last update of a window is its result.

    A window's state is dropped when the watermark passes its end. `lateness` unset: the disorder of the files, so windows close as early as they can without an event being late. Set
    to less, late events are left out: `late_events` has them.
    """
    schema = spark.read.parquet(path).schema
    lateness = lateness or f"{int(disorder(spark, path) * 1000) + 1} milliseconds"
    base = new_path(spark, "windows")
    out = base + "/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    stream = windowed(source.parquet(_source(path)), width, lateness)
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", base + "/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.option("recursiveFileLookup", "true").parquet(out)
    last = changes.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total", "highest"), "at").alias("last"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", F.col("last.n").alias("n"), F.round("last.total", 6).alias("total"), F.col("last.highest").alias("highest"))


def merge_latest(batch: DataFrame, number: int, target: str, key: str, order: str) -> None:
    """For foreachBatch: the last record of each key of the table so far and the batch, as version `number` of the table. A version is never changed once it is there: a batch that is
    played again writes the same one, and a crash leaves the version before."""
    spark = batch.sparkSession
    before = latest_version(spark, target, number)
    log = batch if before is None else spark.read.schema(batch.schema).parquet(before).unionByName(batch)
    rows = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("row")).select("row.*")
    rows.write.mode("overwrite").parquet(f"{target}/version-{number:012d}")


def latest_version(spark: SparkSession, target: str, below: int | None = None) -> str | None:
    """The newest whole version of a table (older than `below`), if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [n for n in names if n.startswith("version-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")) and (below is None or int(n[8:]) < below)]
    return f"{target}/{max(whole)}" if whole else None
