"""Plumbing shared by the corpus operators: staged tables, row locators, batch sizes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python: long texts make large batches, so it stays far below Spark's default.
BATCH_ROWS = 128
LOCATOR = "__rl_locator"
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; unset, a temporary one on a local master, else the warehouse."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if spark._jvm.org.apache.hadoop.fs.Path(house).toUri().getScheme() in (None, "file"):
            raise ValueError("a cluster needs spark.checkpoint.dir, or a warehouse that all machines share")
        return house + "/_rankloom"
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="rankloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/rankloom-{tag}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete staged tables: those of `paths`, or all that this session has left."""
    for entry in [e for e in _staged if e[0] is spark and (paths is None or e[1] in paths)]:
        _staged.remove(entry)
        delete(spark, entry[1])


def staged(spark: SparkSession) -> set[str]:
    """The paths of the staged tables that this session has left."""
    return {path for owner, path in _staged if owner is spark}


def clean_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished plans now and not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Stage:
    """Tables an operator writes to the shared folder to cut lineage; `drop` deletes those that are used up."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, f"{self.tag}-{name}")
        tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(tidy, None)
        self.spark.conf.set(tidy, "true")  # what this plan shuffles goes when its table is written
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(tidy) if before is None else self.spark.conf.set(tidy, before)
        self.paths[name] = path
        clean_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def adopt(self, name: str, path: str) -> None:
        """Take charge of a folder that another writer fills."""
        _staged.append((self.spark, path))
        self.paths[name] = path

    def drop(self, *names: str) -> None:
        release(self.spark, [self.paths.pop(n) for n in names if n in self.paths])


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python workers get (a session setting, read when a query starts)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run):
    """A map over Arrow batches that gives its memory back when a task ends: Python workers outlive their tasks."""

    def wrapped(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def with_locator(docs: DataFrame, columns: list[Column] | None = None, stage: Stage | None = None) -> DataFrame:
    """`docs` (or `columns` of it) and where each row lies: its file's path as a 64-bit hash and its row index, the same at every reading.

    A frame that is no plain file scan has no such place; it is written to the shared folder first.
    """
    columns = columns if columns is not None else [docs[c] for c in docs.columns]
    place = F.concat_ws("#", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string")).alias(LOCATOR)
    try:
        return docs.select(*columns, place)
    except AnalysisException:
        stage = stage or Stage(docs.sparkSession, "rows")
        return stage.write("rows", docs.select(*columns)).select("*", place)


def settled(docs: DataFrame) -> DataFrame:
    """`docs` if its rows have a place (a plain file scan), else a copy of it in the shared folder: two readings then name the same rows alike."""
    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        return Stage(docs.sparkSession, "rows").write("rows", docs)


#: The largest filter that `may_be_in` sends to all tasks: 32 MB, whatever the input.
FILTER_BITS = 1 << 28
_WORD = 1 << 15  # bits in one bitmap of bitmap_construct_agg


def may_be_in(rows: DataFrame, column: str, keys: DataFrame, stage: Stage, name: str) -> DataFrame:
    """`rows` and `__may`: false only if the value of `column` is not among the first column of `keys` (a staged table).

    A hashed bitmap of sixteen bits a key, of FILTER_BITS at most, is sent to all tasks; where it fills up, more rows may be in. DataFrame operators only.
    """
    bits = min(FILTER_BITS, max(_WORD, 1 << (16 * keys.count() - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = keys.select(place(F.col(keys.columns[0])).alias("p"))
    maps = at.groupBy(F.expr(f"p div {_WORD}").alias("__bucket")).agg(F.bitmap_construct_agg(F.col("p") % _WORD).alias("__map"))
    maps = stage.write(name, maps)  # at most FILTER_BITS / 8 bytes
    found = rows.withColumn("__place", place(F.col(column))).join(F.broadcast(maps), F.expr(f"__place div {_WORD}") == F.col("__bucket"), "left")
    byte = F.substring("__map", (F.expr(f"__place % {_WORD} div 8") + 1).cast("int"), F.lit(1))
    bit = F.expr("shiftright(cast(conv(hex(__byte), 16, 10) as int), cast(__place % 8 as int)) & 1 = 1")
    found = found.withColumn("__byte", byte).withColumn("__may", F.coalesce(bit, F.lit(False)))
    return found.drop("__place", "__bucket", "__map", "__byte")


def pick(docs: DataFrame, column: str) -> Column:
    """A column by its exact name, also if the name holds dots."""
    return docs["`" + column.replace("`", "``") + "`"]


def clean_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))
