"""Sinks: committed JSON and Parquet tables, canonical lines, indexes, published reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..operators.ranking import dot


def canonical_json(rows: DataFrame) -> Column:
    """A row as JSON with its fields by name, no blanks, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """Canonical lines; the files appear together when the job commits."""
    rows.select(canonical_json(rows).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One canonical JSON value as a file of any store that Spark writes to: written beside its place and renamed over it in one step, so a reader sees the old or the new one whole, also if
    the writer dies between."""
    import json

    jvm = spark._jvm
    place, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".next")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(place), how)


def append_record(records: DataFrame, path: str, identity: str) -> None:
    """Checkpoint records of a run, with its identity, as further committed files of a log."""
    write_jsonl(records.withColumn("identity", F.lit(identity)), path, append=True)


def write_vector_index(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "vector") -> None:
    """A vector table that `readers.vector_index` reads, each vector of unit norm and ranged by id."""
    norm = F.sqrt(dot(F.col(vector_col), F.col(vector_col)))
    unit = F.transform(vector_col, lambda x: (x / norm).cast("float"))
    vectors.withColumn(vector_col, unit).repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("overwrite").parquet(path)


def mean_pooled(rows: DataFrame, id_col: str, hidden: str, mask: str) -> DataFrame:
    """(id, vector): of a text's token vectors (an array of arrays) the mean of those that its mask (an array of 0 and 1) lets through, of unit norm.

    A text without such tokens, or with a null, has a vector of zeros if its width is known from its tokens, else an empty one.
    """
    schema = T.StructType([rows.schema[id_col], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens_, lets in zip(batch[hidden].to_pylist(), batch[mask].to_pylist(), strict=True):
                h = np.array(tokens_ or np.zeros((0, 0)), np.float64)
                w = np.array((lets or [])[: len(h)] + [0] * (len(h) - len(lets or [])), np.float64)
                out.append(unit(w @ h / max(w.sum(), 1e-9)) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(out, pa.list_(pa.float32()))], [id_col, "vector"])

    return rows.select(id_col, hidden, mask).mapInArrow(run, schema)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v**2).sum())
    return v / norm if norm else v


def mean_pooled_tokens(tokens_: DataFrame, id_col: str, vector: str, mask: Column) -> DataFrame:
    """As `mean_pooled`, of a row a token: a task adds up what it has of a text, so a text's tokens are shuffled as one sum a task, however many it has."""
    sums = T.StructType([tokens_.schema[id_col], T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.DoubleType())])
    schema = T.StructType([tokens_.schema[id_col], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def add(ids: list, vectors: list, counts: list) -> dict:
        total: dict = {}
        for i, v, n in zip(ids, vectors, counts, strict=True):
            held = total.setdefault(i, [np.zeros(len(v)), 0.0])
            held[0] = held[0] + np.array(v)
            held[1] += n
        return total

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.asarray(batch["w"].to_numpy(zero_copy_only=False), np.float64)
            x = np.asarray(batch["v"].flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) * w[:, None]
            total = add(batch[id_col].to_pylist(), x, w)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), batch.schema.field(id_col).type), pa.array([t[0] for t in total.values()], pa.list_(pa.float64())), pa.array([t[1] for t in total.values()], pa.float64())], [id_col, "s", "n"])

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(add(["all"] * table.num_rows, table["s"].to_pylist(), table["n"].to_pylist()).values())
        return pa.table({id_col: table[id_col][:1], "vector": pa.array([unit(rows[0][0] / max(rows[0][1], 1e-9))], pa.list_(pa.float32()))})

    rows = tokens_.select(id_col, F.col(vector).cast("array<double>").alias("v"), F.coalesce(mask.cast("double"), F.lit(0.0)).alias("w")).where("v is not null")
    return rows.mapInArrow(partial, sums).groupBy(id_col).applyInArrow(whole, schema)


def embed(texts: DataFrame, id_col: str, text_col: str, encode: Callable[[list[str]], list[list[float]]], path: str, batch: int = 256) -> None:
    """Vectors of texts by a model, `batch` texts at a time, appended to a table; a run that was cut off goes on with the texts that have none yet."""
    spark = texts.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = texts.select(id_col, text_col)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.parquet(path).select(id_col), id_col, "left_anti")
    schema = T.StructType([texts.schema[id_col], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches):
        for frame in batches:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({id_col: part[id_col], "vector": [list(map(float, v)) for v in encode(part[text_col].fillna("").tolist())]})

    rows.mapInPandas(run, schema).write.mode("append").parquet(path)


def write_postings(docs: DataFrame, id_col: str, title: Column, text: Column, path: str, buckets: int | None = None) -> None:
    """A full-text index: postings (term, doc_id, title_tf, text_tf), ranged by term so that a query's terms prune files by their statistics, and pages (doc_id, page_id, title_length, text_length) to look titles up."""
    words = docs.select(F.col(id_col).alias("doc_id"), title.alias("title"), tokens(title).alias("tw"), tokens(text).alias("bw"))
    both = F.concat(F.transform("tw", lambda w: F.struct(w.alias("term"), F.lit(1).alias("t"), F.lit(0).alias("b"))), F.transform("bw", lambda w: F.struct(w.alias("term"), F.lit(0).alias("t"), F.lit(1).alias("b"))))
    table = words.select("doc_id", F.explode(both).alias("x")).groupBy("x.term", "doc_id").agg(F.sum("x.t").alias("title_tf"), F.sum("x.b").alias("text_tf"))
    table = table.repartitionByRange(buckets, "term") if buckets else table.repartitionByRange("term")
    table.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path + "/postings")
    words.select("doc_id", F.translate("title", " ", "_").alias("page_id"), F.size("tw").alias("title_length"), F.size("bw").alias("text_length")).write.mode("overwrite").parquet(path + "/pages")


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(term, doc_id, title_tf, text_tf, title_length, text_length) of a query's terms."""
    return spark.read.parquet(path + "/postings").where(F.col("term").isin(terms)).join(spark.read.parquet(path + "/pages"), "doc_id")


#: What a published report leaves out.
TIMINGS = ("latency_ms_per_query", "ranking_latency_ms_per_query")


def publish(report: DataFrame, required: list[str], status: str, timings: tuple[str, ...] = TIMINGS) -> DataFrame:
    """A report without its timing columns, with a status; a required column that is missing is an error."""
    missing = [c for c in required if c not in report.columns]
    if missing:
        raise ValueError(f"report lacks {', '.join(missing)}")
    return report.drop(*timings).withColumn("status", F.lit(status))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeats counted: empty if a regenerated table equals the written one."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def gate_summary(decisions: list, decision: str) -> str:
    """A pull request's summary: the decision and the table of its metrics."""
    return f"## {decision}\n\n" + markdown_table(decisions, ["metric", "baseline", "candidate", "delta", "decision"])


def markdown_table(rows: list, columns: list[str]) -> str:
    """A small collected summary as Markdown."""
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])
