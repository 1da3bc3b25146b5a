"""Freezes, fingerprints and prompts against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rankloom.operators import freezes


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_freeze_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_bytes(b'{"x": 1}\r\n\xff\r')
    (tmp_path / "sub" / "b.json").write_bytes(b"\n")
    (tmp_path / "none.json").write_bytes(b"")
    files = freezes.file_hashes(spark, str(tmp_path), "*.json")
    plain = {"a.json": sha(b'{"x": 1}\n\xff\r'), "sub/b.json": sha(b"\n")}
    assert {r.path: r.sha256 for r in files.collect()} == plain
    claims = spark.createDataFrame([("review", "a.json", plain["a.json"])], "artifact string, path string, sha256 string")
    facts = spark.createDataFrame([("review.version", "2"), ("bakeoff.version", "2"), ("empty", None)], "name string, value string")
    rules = lambda *r: spark.createDataFrame(list(r), "code string, left string, right string")
    fine = rules(("versions", "review.version", "bakeoff.version"), ("value", "review.version", "2"))
    assert {r.path: r.sha256 for r in freezes.freeze(files, claims, facts, fine).collect()} == plain
    wrong = claims.union(spark.createDataFrame([("x", "gone.json", "00"), ("x", "sub/b.json", "00")], claims.schema))
    assert {(r.path, r.code) for r in freezes.hash_faults(files, wrong).collect()} == {("gone.json", "missing"), ("sub/b.json", "hash_mismatch")}
    assert {r.code for r in freezes.equality_faults(facts, rules(("a", "review.version", "3"), ("b", "empty", "empty"), ("c", "nothing", "2"), ("d", "review.version", "2"))).collect()} == {"a", "b", "c"}
    with pytest.raises(Exception, match="not frozen: hash_mismatch sub/b.json, missing gone.json"):
        freezes.freeze(files, wrong, facts, fine).collect()


def test_fingerprints(spark):
    parts = {"meta.json": "ab", 'q"uote': None, "chunks": "cd"}
    df = spark.createDataFrame(list(parts.items()), "path string, sha256 string")
    assert freezes.fingerprint(df).first().fingerprint == sha(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode())
    two = freezes.fingerprint(df.withColumn("v", F.lit(1)).union(df.limit(1).withColumn("v", F.lit(2))), ["v"])
    assert {r.v for r in two.collect()} == {1, 2} and len({r.fingerprint for r in two.collect()}) == 2


def test_prompts(spark):
    source = "array<struct<citation_id: string, document_id: string, title: string, text: string>>"
    rows = [(f"c{i}", "fever" if i == 9 else "hotpotqa", 0 if i == 9 else i, f"q{i}?", [("D1", "secret", "T", 'x "y"')] if i else None) for i in (2, 0, 1, 9)]
    work = spark.createDataFrame(rows, f"case_id string, benchmark_id string, position int, query string, contexts {source}")
    found = {(r.benchmark_id, r.batch_no): r for r in freezes.prompts(work, {"hotpotqa": "Cite the chain.", "fever": "Give a label."}, "Answer in JSON.", 2, {"frozen": F.lit(None).cast("string")}).collect()}
    assert {k: (r.task, r.case_ids) for k, r in found.items()} == {("hotpotqa", 0): ("question_answering", ["c0", "c1"]), ("hotpotqa", 1): ("question_answering", ["c2"]), ("fever", 0): ("fact_verification", ["c9"])}
    head, body = found["hotpotqa", 0].prompt.split("\n\n")
    assert head == "Task: question_answering. Cite the chain. Answer in JSON."
    assert json.loads(body) == [{"case_id": "c0", "query": "q0?", "frozen": None, "retrieved_evidence": []}, {"case_id": "c1", "query": "q1?", "frozen": None, "retrieved_evidence": [{"citation_id": "D1", "title": "T", "text": 'x "y"'}]}]
    assert "secret" not in body and freezes.prompts(work.limit(0), {"fever": "x"}, "y", 2).count() == 0
    with pytest.raises(Exception, match="no instruction for"):
        freezes.prompts(work, {"fever": "x"}, "y", 2).collect()
