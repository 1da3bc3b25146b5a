"""Frozen artifacts and what is asked of a model: file hashes, claims on them, equalities between artifacts, version fingerprints, prompts of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tasks' names, and the labels and the answer of an abstention that a prompt names.
FACTS, QUESTIONS = "fact_verification", "question_answering"


def file_hashes(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, sha256) of the files under a folder, by their path below it; line ends count as single line feeds, so that checkouts agree. A row a file, read by the executors.
    Files without a byte are not read and have no row: a claim on one counts as missing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    bytes_ = F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    folder = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return files.select(F.substr("path", F.instr("path", folder) + len(folder)).alias("path"), F.sha2(bytes_, 256).alias("sha256"))


def fingerprint(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by,] fingerprint): the hash of a JSON object of names and hashes in order of names, without blanks; a file that is not there (null) counts as null. The parts of a version are few."""
    key = lambda c: F.get(F.split(F.to_json(F.array(c)), r"^\[|\]$"), F.lit(1))
    pair = F.concat(key(F.col("path")), F.lit(":"), F.coalesce(key(F.col("sha256")), F.lit("null")))
    one = files.select(*(by or []), "path", F.when(F.col("sha256").isNull(), F.concat(key(F.col("path")), F.lit(":null"))).otherwise(pair).alias("p"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("path", "p"))), lambda x: x["p"])
    return one.groupBy(*(by or [])).agg(F.sha2(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), 256).alias("fingerprint"))


def hash_faults(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(artifact, path, code) of claims (artifact, path, sha256) that don't hold: `missing` files and `hash_mismatch`."""
    rows = claims.join(files.select("path", F.col("sha256").alias("__is")), "path", "left")
    code = F.when(F.col("__is").isNull(), "missing").when(~F.col("__is").eqNullSafe(F.col("sha256")), "hash_mismatch")
    return rows.select("artifact", "path", code.alias("code")).where("code IS NOT NULL")


def equality_faults(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(code, left_value, right_value) of rules (code, left, right) on facts (name, value) that are not there or not equal. A right side that is no fact's name is a value."""
    value = lambda side: facts.select(F.col("name").alias(side), F.col("value").alias(f"{side}_value"), F.lit(True).alias(f"__{side}"))
    rows = rules.join(value("left"), "left", "left").join(value("right"), "right", "left")
    rows = rows.withColumn("right_value", F.when(F.col("__right"), F.col("right_value")).otherwise(F.col("right")))
    return rows.where(F.col("left_value").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select("code", "left_value", "right_value")


def freeze(files: DataFrame, claims: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """The files' (path, sha256); an error that names the faults if any claim or equality does not hold."""
    faults = hash_faults(files, claims).select(F.concat_ws(" ", "code", "path").alias("f")).unionByName(equality_faults(facts, rules).select(F.col("code").alias("f")))
    found = faults.agg(F.array_join(F.slice(F.array_sort(F.collect_set("f")), 1, 20), ", ").alias("__faults"))
    rows = files.select("path", "sha256").crossJoin(F.broadcast(found))  # one row
    return rows.where(F.when(F.col("__faults") == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not frozen: "), F.col("__faults"))))).select("path", "sha256")


def prompts(work: DataFrame, instructions: dict[str, str], general: str, size: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """(benchmark_id, batch_no, task, case_ids, prompt) of work items (case_id, benchmark_id, position, query, contexts): batches of `size` cases of a benchmark in order of positions 0, 1, ...

    A prompt is the task, the benchmark's instruction, the general one, and the cases as JSON with the evidence under local ids; the same items give the same text. `extra` adds fields
    to each case, such as a frozen prediction. A benchmark without an instruction is an error.
    """
    source = F.transform("contexts", lambda c: F.struct(c["citation_id"].alias("citation_id"), c["title"].alias("title"), c["text"].alias("text")))
    more = [c.alias(n) for n, c in (extra or {}).items()]
    case = F.struct("case_id", "query", *more, F.coalesce(source, F.array().cast("array<struct<citation_id: string, title: string, text: string>>")).alias("retrieved_evidence"))
    rows = work.select("benchmark_id", F.floor(F.col("position") / size).alias("batch_no"), "position", "case_id", case.alias("case"))
    rows = rows.groupBy("benchmark_id", "batch_no").agg(F.sort_array(F.collect_list(F.struct("position", "case_id", "case"))).alias("b"))  # at most `size` cases a batch
    task = F.when(F.col("benchmark_id") == "fever", FACTS).otherwise(QUESTIONS)
    texts = F.create_map(*[F.lit(x) for pair in instructions.items() for x in pair])
    told = F.coalesce(F.try_element_at(texts, F.col("benchmark_id")), F.raise_error(F.concat(F.lit("no instruction for "), "benchmark_id")).cast("string"))
    text = F.concat(F.lit("Task: "), task, F.lit(". "), told, F.lit(f" {general}\n\n"), F.to_json(F.col("b")["case"], {"ignoreNullFields": "false"}))
    return rows.select("benchmark_id", "batch_no", task.alias("task"), F.col("b")["case_id"].alias("case_ids"), text.alias("prompt"))
