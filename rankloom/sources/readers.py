"""Scans: JSONL in its several shapes, Markdown corpora, file manifests, vector indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ranking import dot


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records, one a line; blank lines are skipped. The schema is given: nothing is inferred by a second reading."""
    return spark.read.schema(schema).json(path)


def _parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """`lines` (value, ...) with `r`, the record, and `wrong`: no object of this schema; values of another type than the schema's are wrong too."""
    full = schema if "__bad" in schema.fieldNames() else StructType([*schema.fields, StructField("__bad", StringType())])
    rows = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    return rows.withColumn("wrong", F.json_object_keys("value").isNull() | F.col("r").isNull() | F.col("r.__bad").isNotNull())


def jsonl_faults(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line, value) of the lines that are no record of this schema, lines counted from 1, blank ones too.

    A file is read in splits, which know where they begin but not how many lines come before: a split's lines are counted, and the counts of a file's earlier splits added up. Only faults meet these counts.
    """
    places = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select("value", *places)
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    wrong = _parsed(lines.where(F.trim("value") != ""), schema).where("wrong")
    return wrong.join(splits, ["file", "block"]).select("file", (F.col("lines") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def strict_jsonl(spark: SparkSession, path: str, schema: StructType, numbered: bool = False) -> DataFrame:
    """As `jsonl`, with a row that is no object of this schema failing the query where it is met, with its file and text. `numbered`: the files are read through first, and the first fault is
    raised at once with its line's number."""
    if numbered and (fault := jsonl_faults(spark, path, schema).orderBy("file", "line").first()):
        raise ValueError(f"not a record: {fault.file}:{fault.line}: {fault.value[:200]}")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file")).where(F.trim("value") != "")
    rows = _parsed(lines, schema)
    where = F.concat(F.lit("not a record: "), F.col("__file"), F.lit(": "), F.substring("value", 1, 200))
    rows = rows.where(F.when(F.col("wrong"), F.raise_error(where)).otherwise(F.lit(True)))
    return rows.select(*[F.col("r")[f].alias(f) for f in schema.fieldNames()])


def cases(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Cases of a file that holds lines, one array, or an object with `cases`. `element` is the DDL of a case."""
    text = spark.read.text(path, wholetext=True)
    value = F.trim("value")
    whole = F.when(value.startswith("["), value).when(value.rlike(r'^\{\s*"cases"'), F.get_json_object(value, "$.cases"))
    lines = F.filter(F.split(value, r"\r?\n"), lambda l: F.trim(l) != "")
    parsed = F.when(whole.isNotNull(), F.from_json(whole, f"array<struct<{element}>>")).otherwise(F.transform(lines, lambda l: F.from_json(l, f"struct<{element}>")))
    return text.select(F.explode(parsed).alias("case")).select("case.*")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of Markdown files; the id is the file's name without its ending."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(file, r"([^/]+)\.md$", 1).alias("doc_id"), file.alias("path"), F.col("value").alias("text"))


def artifacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, bytes, sha256) of every file under a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_sha256(files: DataFrame) -> DataFrame:
    """(sha256) of a source: of its one file, or of the canonical list of its files (name, bytes, sha256) in order of name; no files are an error."""
    listed = files.agg(F.sort_array(F.collect_list(F.struct("name", "bytes", "sha256"))).alias("f"))
    one = F.transform("f", lambda x: F.struct(x["bytes"].alias("bytes"), x["name"].alias("name"), x["sha256"].alias("sha256")))
    digest = F.when(F.size("f") == 0, F.raise_error(F.lit("no source artifacts"))).when(F.size("f") == 1, F.get("f", F.lit(0))["sha256"]).otherwise(F.sha2(F.to_json(one), 256))
    return listed.select(digest.alias("sha256"))


def registry(spark: SparkSession, path: str, key: str, required: tuple[str, ...]) -> list[dict]:
    """A small list of entries from a JSON file, read through Spark so that any store will do: each has the required fields and an id of its own."""
    import json

    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    entries = found if isinstance(found, list) else next(iter(v for v in found.values() if isinstance(v, list)), [])
    lacks = [e for e in entries if set(required) - set(e)]
    if lacks or len({e[key] for e in entries}) < len(entries):
        raise ValueError("a registry entry lacks fields or has another's id")
    return entries


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, line, value): the lines of all text members of ZIP files, members in order of name. An archive is one task; its members are streamed and never held whole."""
    import io
    import zipfile

    import pandas as pd

    def lines(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if not n.endswith("/")):
                        with z.open(member) as f:
                            held = []
                            for i, raw in enumerate(io.TextIOWrapper(f, encoding="utf-8", newline="\n")):
                                held.append((name, member, i, raw.rstrip("\r\n")))
                                if len(held) == 10_000:
                                    yield pd.DataFrame(held, columns=["archive", "member", "line", "value"])
                                    held = []
                            if held:
                                yield pd.DataFrame(held, columns=["archive", "member", "line", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(lines, "archive string, member string, line long, value string")


def vector_index(spark: SparkSession, path: str, id_col: str = "id", vector_col: str = "vector", tolerance: float = 1e-4, expected: int | None = None) -> DataFrame:
    """A vector table whose every row is checked as it is read: finite, of one width, of unit norm. With `expected`, the number of rows and that ids are single are checked first."""
    rows = spark.read.parquet(path)
    if expected is not None:
        faults = [r.fault for r in index_faults(rows, id_col, expected).where("n > 0").collect()]
        if faults:
            raise ValueError(f"vector index has {', '.join(faults)}")
    v = F.col(vector_col)
    norm = F.sqrt(dot(v, v))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    fault = F.when(~finite, F.raise_error(F.lit("vector is not finite"))).when(F.abs(norm - 1) > tolerance, F.raise_error(F.lit("vector is not L2-normalized")))
    checked = rows.withColumn("_fault", fault).where(F.col("_fault").isNull()).drop("_fault")
    return checked


def index_faults(index: DataFrame, id_col: str = "id", expected: int | None = None) -> DataFrame:
    """(fault, n): duplicate ids and a wrong count."""
    double = index.groupBy(id_col).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_id").alias("fault"), "n")
    if expected is None:
        return double
    short = index.agg(F.abs(F.count("*") - expected).alias("n")).select(F.lit("row_count").alias("fault"), "n")
    return double.unionByName(short)
