import datetime
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.sources import benchmarks, readers, writers


def test_jsonl_shapes_and_strictness(spark, tmp_path):
    lines, array, wrapped, bad = (str(tmp_path / n) for n in ("a.jsonl", "b.json", "c.json", "d.jsonl"))
    open(lines, "w").write('{"id": "1"}\n\n{"id": "2"}\n')
    open(array, "w").write('[{"id": "1"}, {"id": "2"}]')
    open(wrapped, "w").write('{"cases": [{"id": "1"}, {"id": "2"}]}')
    open(bad, "w").write('{"id": "1"}\n[3\n')
    for p in (lines, array, wrapped):
        assert sorted(r.id for r in readers.cases(spark, p, "id: string").collect()) == ["1", "2"]
    schema = StructType.fromDDL("id string")
    assert readers.strict_jsonl(spark, lines, schema).count() == 2
    with pytest.raises(Exception, match="not a record"):
        readers.strict_jsonl(spark, bad, schema).collect()


def test_vector_index_is_checked(spark, tmp_path):
    for name, rows in (("good", [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]), ("bad", [("a", [2.0, 0.0])])):
        spark.createDataFrame(rows, "id string, vector array<float>").write.parquet(str(tmp_path / name))
    good = readers.vector_index(spark, str(tmp_path / "good"))
    assert good.count() == 2 and readers.index_faults(good, expected=3).where("n > 0").first().fault == "row_count"
    with pytest.raises(Exception, match="not L2-normalized"):
        readers.vector_index(spark, str(tmp_path / "bad")).collect()


def test_written_lines_are_canonical(spark, tmp_path):
    d = spark.createDataFrame([(1, None, "x")], "b int, a string, c string")
    writers.write_jsonl(d, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":null,"b":1,"c":"x"}'
    assert writers.differs(d, d).count() == 0 and writers.differs(d, d.limit(0)).count() == 1
    assert writers.publish(d.withColumn("latency_ms_per_query", F.lit(1)), ["b"], "final").columns == ["b", "a", "c", "status"]
    with pytest.raises(ValueError):
        writers.publish(d, ["gone"], "final")


HOTPOT = "_id string, question string, answer string, supporting_facts array<struct<title: string, sentence_index: int>>, context array<struct<title: string, sentences: array<string>>>"


def test_hotpotqa(spark):
    good = ("q1", "who?", "me", [("T", 0)], [("T", ["s0", "s1"]), ("U", ["x"])])
    c = benchmarks.hotpotqa(spark.createDataFrame([good], HOTPOT)).first()
    assert [d.id for d in c.documents] == ["hotpotqa:q1:doc:0", "hotpotqa:q1:doc:1"] and c.supporting_evidence[0].text == "s0" and c.distractor_document_ids == ["hotpotqa:q1:doc:1"]
    dangling = ("q2", "who?", "me", [("T", 7)], [("T", ["s0"])])
    with pytest.raises(Exception, match="dangling"):
        benchmarks.hotpotqa(spark.createDataFrame([dangling], HOTPOT)).collect()
    with pytest.raises(Exception, match="duplicate id"):
        benchmarks.unique_ids(spark.createDataFrame([good, good], HOTPOT), "_id").collect()


def test_fever(spark):
    claims = spark.createDataFrame([(1, "SUPPORTS", "c", [[("P", 0)], [("P", 1), ("Q", 0)]]), (2, "NOT ENOUGH INFO", "d", [[(None, None)]]), (3, "REFUTES", "e", [[("Gone", 0)]])], "id long, label string, claim string, evidence array<array<struct<page: string, sentence: int>>>")
    pages = spark.createDataFrame([("P", ["p0", "p1"]), ("Q", ["q0"])], "page string, sentences array<string>")
    got = {c.id: c for c in benchmarks.fever(claims, pages).collect()}
    assert set(got) == {"fever:1", "fever:2"} and len(got["fever:1"].evidence_sets) == 2 and [e.text for e in got["fever:1"].supporting_evidence] == ["p0", "p1", "q0"]
    assert got["fever:2"].answerability == "unanswerable" and got["fever:2"].supporting_evidence == []
    assert [tuple(r) for r in benchmarks.missing_pages(claims, pages).select("id", "page").collect()] == [("3", "Gone")]
    lines = spark.createDataFrame([("0\tA\tx\n2\tB",)], "l string").select(benchmarks.fever_sentences(F.col("l")).alias("s")).first().s
    assert lines == ["A", "", "B"]


def test_squad(spark):
    schema = "title string, paragraphs array<struct<context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string, answer_start: int>>, is_impossible: boolean>>>>"
    rows = lambda at: spark.createDataFrame([("t", [("The cat sat", [("1", "who?", [("cat", at)], False), ("2", "why?", [], True)])])], schema)
    got = {c.id: c for c in benchmarks.squad_cases(benchmarks.squad(rows(4))).collect()}
    assert got["squad:1"].answers == ["cat"] and got["squad:2"].answerability == "unanswerable"
    with pytest.raises(Exception, match="not at its offset"):
        benchmarks.squad_cases(benchmarks.squad(rows(5))).collect()


def test_natural_questions_votes(spark):
    schema = "id string, document struct<title: string, tokens: struct<token: array<string>, is_html: array<boolean>>>, question struct<text: string>, long_answer_candidates struct<start_token: array<int>, end_token: array<int>>, annotations struct<long_answer: array<struct<candidate_index: int>>, short_answers: array<struct<text: array<string>>>, yes_no_answer: array<int>>"
    doc = {"title": "T", "tokens": {"token": ["<p>", "a", "b", "</p>", "c"], "is_html": [True, False, False, True, False]}}

    def row(key, chosen, shorts, yes_no):
        return json.loads(json.dumps({"id": key, "document": doc, "question": {"text": "q"}, "long_answer_candidates": {"start_token": [0, 4], "end_token": [4, 5]}, "annotations": {"long_answer": [{"candidate_index": i} for i in chosen], "short_answers": [{"text": s} for s in shorts], "yes_no_answer": yes_no}}))

    none = [-1] * 5
    rows = [row("1", [0, 0, 1, -1, -1], [["a"], ["a"], [], [], []], none), row("2", [0, -1, -1, -1, -1], [[]] * 5, none), row("3", [0, 1, -1, -1, -1], [[]] * 5, none), row("4", [1, 1, 1, -1, -1], [[]] * 5, [1, 1, -1, -1, 0])]
    from pyspark.sql.types import StructType as S

    got = {c.id: c for c in benchmarks.natural_questions(spark.createDataFrame(rows, S.fromDDL(schema))).collect()}
    assert (got["nq:1"].answers, got["nq:1"].evidence_document_ids) == (["a"], ["nq:1:doc:0"])
    assert got["nq:1"].documents[0].sentences == ["a b"]
    assert (got["nq:2"].answerability, got["nq:2"].answers) == ("unanswerable", [])
    assert got["nq:3"].answers == ["a b", "c"] and got["nq:4"].answers == ["yes"]


def test_sources_of_other_shapes(spark, tmp_path):
    cols = "id string, question string, answer string, type string, level string, supporting_facts struct<title: array<string>, sent_id: array<int>>, context struct<title: array<string>, sentences: array<array<string>>>"
    spark.createDataFrame([(f"q{i}", "who?", "me", "t", "l", (["T"], [1]), (["T", "U"], [["s0", "s1"], ["x"]])) for i in range(30)], cols).repartition(3).write.parquet(str(tmp_path / "shards"))
    drawn = benchmarks.sampled_shards(spark, str(tmp_path / "shards"), "id", 5)
    assert drawn.count() == 5
    cases = benchmarks.normalize_many(benchmarks.from_columns(drawn), "_id", benchmarks.hotpotqa, 4)
    assert [c.supporting_evidence[0].text for c in cases.collect()] == ["s1"] * 4
    report = {(r.measure, r.value): r.n for r in benchmarks.conversion_report(cases, 8).collect()}
    assert report["answerability", "answerable"] == 4 and report["cases", "0.500000 of source lost"] == 4
    with pytest.raises(ValueError):
        benchmarks.normalize_many(benchmarks.from_columns(drawn), "_id", benchmarks.hotpotqa, 9)
    with pytest.raises(Exception, match="duplicate id"):
        benchmarks.normalize_many(benchmarks.from_columns(drawn.union(drawn)), "_id", benchmarks.hotpotqa).collect()


def test_fever_source_leaves_out_claims_without_their_pages(spark):
    claims = spark.createDataFrame([(i, "SUPPORTS", "c", [[("P" if i % 3 else "Gone", 0)]]) for i in range(60)] + [(100, "REFUTES", "d", [[("Caf\u00e9", 0)]])], "id long, label string, claim string, evidence array<array<struct<page: string, sentence: int>>>")
    pages = spark.createDataFrame([("P", ["p0"]), ("Cafe\u0301", ["q0"])], "page string, sentences array<string>")
    kept, lost = benchmarks.fever_source(claims, pages, 41)
    assert {r.id for r in kept.collect()} == {i for i in range(60) if i % 3} | {100} and {r.id: r.missing_pages for r in lost.collect()} == {i: ["Gone"] for i in range(0, 60, 3)}


def test_compaction_hashes_the_whole_row(spark):
    row = "id string, document struct<title: string, html: string, tokens: struct<token: array<string>, is_html: array<boolean>, start_byte: array<int>>>, question struct<text: string>, long_answer_candidates struct<start_token: array<int>, end_token: array<int>>, annotations struct<long_answer: array<struct<candidate_index: int>>, short_answers: array<struct<text: array<string>>>, yes_no_answer: array<int>>"
    make = lambda html: spark.createDataFrame([("1", ("T", html, (["a"], [False], [0])), ("q",), ([0], [1]), ([(0,)] * 5, [([],)] * 5, [-1] * 5))], row)
    a, b = (benchmarks.compact_natural_questions(make(h)) for h in ("x", "y"))
    assert a.first()._source_record_sha256 != b.first()._source_record_sha256 and "html:string" not in a.schema.simpleString()
    assert benchmarks.natural_questions(a).first().answerability == "answerable"


def test_archives_registries_and_manifests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "w.zip", "w") as z:
        z.writestr("b.jsonl", "3\n")
        z.writestr("a.jsonl", "1\n2")
    got = readers.zip_lines(spark, str(tmp_path / "in")).collect()
    assert [(r.member, r.line, r.value) for r in got] == [("a.jsonl", 0, "1"), ("a.jsonl", 1, "2"), ("b.jsonl", 0, "3")]
    (tmp_path / "r.json").write_text(json.dumps({"benchmarks": [{"id": "a", "x": 1}, {"id": "b", "x": 2}]}))
    assert len(readers.registry(spark, str(tmp_path / "r.json"), "id", ("id", "x"))) == 2
    with pytest.raises(ValueError):
        readers.registry(spark, str(tmp_path / "r.json"), "id", ("id", "y"))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "doc.md").write_text("# A\ntext")
    files = readers.artifacts(spark, str(tmp_path / "m"))
    one = files.first()
    assert (one["name"], one["bytes"]) == ("doc.md", 8) and readers.manifest_sha256(files).first().sha256 == one.sha256
    (tmp_path / "m" / "e.md").write_text("x")
    assert readers.manifest_sha256(readers.artifacts(spark, str(tmp_path / "m"))).first().sha256 != one.sha256
    assert sorted((r.doc_id, r.text) for r in readers.markdown(spark, str(tmp_path / "m")).collect()) == [("doc", "# A\ntext"), ("e", "x")]


def test_sinks(spark, tmp_path):
    writers.write_json(spark, str(tmp_path / "v.json"), {"b": 1, "a": "é"})
    writers.write_json(spark, str(tmp_path / "v.json"), {"b": 2})
    assert json.loads((tmp_path / "v.json").read_text()) == {"b": 2} and not (tmp_path / "v.json.next").exists()
    v = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "id string, vector array<double>")
    writers.write_vector_index(v, str(tmp_path / "v"))
    assert readers.vector_index(spark, str(tmp_path / "v"), expected=2).count() == 2
    with pytest.raises(ValueError):
        readers.vector_index(spark, str(tmp_path / "v"), expected=3)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, text string")
    encode = lambda ts: [[float(len(t)), 1.0] for t in ts]
    writers.embed(texts.where("id < 3"), "id", "text", encode, str(tmp_path / "e"), 2)
    writers.embed(texts, "id", "text", encode, str(tmp_path / "e"), 2)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "e")).collect()) == list(range(7))
    docs = spark.createDataFrame([(1, "Big Cat", "a cat sat"), (2, "Dog", "no")], "id int, title string, body string")
    writers.write_postings(docs, "id", F.col("title"), F.col("body"), str(tmp_path / "p"))
    got = [tuple(r) for r in writers.read_postings(spark, str(tmp_path / "p"), ["cat"]).select("doc_id", "title_tf", "text_tf", "page_id", "text_length").collect()]
    assert got == [(1, 1, 1, "Big_Cat", 3)]
    rows = spark.createDataFrame([("b1", 1, True)], "batch_id string, sequence int, valid boolean")
    writers.append_record(rows, str(tmp_path / "log"), "run")
    writers.append_record(rows, str(tmp_path / "log"), "run")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert writers.gate_summary([{"metric": "m", "baseline": 0.5, "candidate": None, "delta": None, "decision": "REJECT"}], "REJECT").splitlines()[-1] == "| m | 0.5000 | n/a | n/a | REJECT |"


def test_faults_have_line_numbers_of_split_files(spark, tmp_path):
    rng = random.Random(1)
    texts = {"a.jsonl": [], "b.jsonl": []}
    bad = set()
    for name, lines in texts.items():
        for n in range(1, 400):
            kind = rng.random()
            lines.append("" if kind < 0.1 else '{"id": 3' if kind < 0.15 else f'[{n}]' if kind < 0.2 else json.dumps({"id": "x" * rng.randrange(30)}))
            if 0.1 <= kind < 0.2:
                bad.add((name, n, lines[-1]))
        (tmp_path / name).write_text("\n".join(lines) + rng.choice(["", "\n"]))
    schema = StructType.fromDDL("id string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # files in several splits
    try:
        assert spark.read.text(f"{tmp_path}/*.jsonl").rdd.getNumPartitions() > 4
        got = {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in readers.jsonl_faults(spark, f"{tmp_path}/*.jsonl", schema).collect()}
        assert got == bad
        line = min(n for name, n, _ in bad if name == "a.jsonl")
        with pytest.raises(ValueError, match=f"a.jsonl:{line}:"):
            readers.strict_jsonl(spark, f"{tmp_path}/*.jsonl", schema, numbered=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_token_vectors_are_pooled(spark):
    rng = np.random.default_rng(2)
    texts = {i: (rng.normal(size=(n, 4)), rng.integers(0, 2, n)) for i, n in enumerate([1, 3, 40, 7])} | {9: (np.ones((2, 4)), np.zeros(2, int))}

    def want(h, m):
        v = (h * m[:, None]).sum(0) / max(m.sum(), 1)
        return pytest.approx(v / (np.linalg.norm(v) or 1), abs=1e-6)

    rows = spark.createDataFrame([(i, h.tolist(), m.tolist()) for i, (h, m) in texts.items()] + [(20, None, None), (21, [], [])], "id int, h array<array<double>>, m array<int>")
    got = {r.id: r.vector for r in writers.mean_pooled(rows, "id", "h", "m").collect()}
    assert got.pop(20) == got.pop(21) == [] and {i: want(*x) for i, x in texts.items()} == got
    tokens = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (h, m) in texts.items() for x, y in zip(h, m, strict=True)], "id int, v array<float>, m int")
    got = {r.id: r.vector for r in writers.mean_pooled_tokens(tokens.repartition(5), "id", "v", F.col("m")).collect()}
    assert {i: want(*x) for i, x in texts.items()} == got


def test_windows_close_and_late_events_are_left_aside(spark, tmp_path):
    import os

    from rankloom.streaming import telemetry

    rng = random.Random(5)
    at = datetime.datetime(2024, 1, 1)
    for k in range(6):  # a file covers an hour and goes back a third of one at most; one event of the fourth file goes back three hours
        rows = [(at + datetime.timedelta(minutes=60 * k + rng.uniform(-20, 59)), rng.choice("ab"), rng.random()) for _ in range(40)] + [(at + datetime.timedelta(minutes=60 * k + 59), "a", 1.0)]
        rows += [(at + datetime.timedelta(minutes=5), "a", 9.0)] if k == 3 else []
        path = f"{tmp_path}/f{k}"
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(path)
        part = next(n for n in os.listdir(path) if n.startswith("part-"))
        os.makedirs(f"{tmp_path}/events", exist_ok=True)
        os.rename(f"{path}/{part}", f"{tmp_path}/events/{9 - k}.parquet")
        os.utime(f"{tmp_path}/events/{9 - k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    path = f"{tmp_path}/events"
    events = spark.read.parquet(path)

    def batch(df):
        w = df.groupBy(F.window("ts", "30 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
        return sorted((r.window.start.strftime("%Y-%m-%d %H:%M:%S"), r.event_type, r.n, r.total) for r in w.collect())

    run = lambda **kw: sorted((r.window_start, r.event_type, r.n, r.total) for r in telemetry.run_windows(spark, path, "30 minutes", files_per_batch=1, **kw).collect())
    assert 10_000 < telemetry.disorder(spark, path) < 10_500  # 174 minutes back
    assert run() == batch(events)  # by the data's own disorder no event is late
    late = telemetry.late_events(spark, path, "30 minutes", "25 minutes")
    assert [(r.event_type, r.value) for r in late.collect()] == [("a", 9.0)]
    assert run(lateness="25 minutes") == batch(events.exceptAll(late))
    assert telemetry.late_events(spark, path, "30 minutes", "0 seconds").count() >= 1


def test_latest_versions_survive_a_replay(spark, tmp_path):
    from rankloom.streaming import telemetry

    t, ddl = str(tmp_path / "t"), "k string, at int, v string"
    telemetry.merge_latest(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], ddl), 0, t, "k", "at")
    for _ in range(2):
        telemetry.merge_latest(spark.createDataFrame([("a", 2, "z"), ("b", 0, "old")], ddl), 1, t, "k", "at")
    newest = telemetry.latest_version(spark, t)
    assert newest.endswith("1") and sorted((r.k, r.v) for r in spark.read.parquet(newest).collect()) == [("a", "z"), ("b", "y")]
