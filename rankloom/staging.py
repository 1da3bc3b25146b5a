"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary folder on a local master, else a folder beside the warehouse's tables."""
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
        _own_dir.append(tempfile.mkdtemp(prefix="rankloom-staged-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path that `release` will delete."""
    path = f"{shared_dir(spark)}/rankloom-{tag}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once and read again: later plans start from its files, whose size Spark knows."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt to all cores if its files are read in fewer parts than there are cores. Only then is it shuffled, so what is shuffled is less than one file split a core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Delete what the session has staged; results that still read it are lost."""
    for entry in [e for e in _staged if e[0] is spark]:
        _staged.remove(entry)
        path = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
