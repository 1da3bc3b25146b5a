"""Question-answering benchmarks as normalised cases: one nested row a question, built with array functions and no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import composed
from ..operators import sampling
from ..staging import staged

EMPTY = "array<string>"


def _fail(test: Column, message: Column) -> Column:
    return F.when(test, F.raise_error(message))


def _checked(rows: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    fault = F.coalesce(*[_fail(F.coalesce(t, F.lit(False)), m) for t, m in rules])
    return rows.withColumn("_fault", fault.cast("string")).where(F.col("_fault").isNull()).drop("_fault")


def _documents(of: Column, benchmark: str, key: Column, part: str = "doc", name: str = "title") -> Column:
    """Positional ids for an array of (title, sentences), with digests of their canonical JSON, where the title goes by `name`."""

    def digest(d: Column) -> Column:
        fields = sorted([(name, d["title"]), ("sentences", d["sentences"])], key=lambda f: f[0])
        return F.sha2(F.to_json(F.struct(*[v.alias(n) for n, v in fields])), 256)

    title = (lambda d: F.replace(d["title"], F.lit("_"), F.lit(" "))) if name == "page_id" else (lambda d: d["title"])
    return F.transform(of, lambda d, i: F.struct(F.concat(F.lit(f"{benchmark}:"), key, F.lit(f":{part}:"), i.cast("string")).alias("id"), title(d).alias("title"), d["sentences"].alias("sentences"), i.alias("source_position"), digest(d).alias("content_sha256"), d["title"].alias("source_title")))


def hotpotqa(records: DataFrame) -> DataFrame:
    """(_id, question, answer, supporting_facts [title, sentence_index], context [title, sentences]) to cases.

    A fact whose title is unknown or not unique, or whose sentence does not exist, fails the query.
    """
    key = F.col("_id")
    docs = _documents(F.col("context"), "hotpotqa", key)
    rows = records.withColumn("documents", docs)
    at = lambda fact: F.filter("documents", lambda d: d["title"] == fact["title"])
    titles = F.col("context")["title"]
    facts = F.transform("supporting_facts", lambda f: F.struct(f["title"].alias("title"), f["sentence_index"].alias("sentence_index")))
    rows = _checked(rows, [
        (F.size(F.array_distinct(titles)) < F.size(titles), F.concat(F.lit("duplicate context title in "), key)), (F.size("supporting_facts") == 0, F.concat(F.lit("no supporting facts in "), key)),
        (F.size(F.array_distinct(facts)) < F.size(facts), F.concat(F.lit("duplicate supporting fact in "), key)), ((F.trim("question") == "") | (F.trim("answer") == ""), F.concat(F.lit("empty question or answer in "), key)),
    ])
    bad = F.exists("supporting_facts", lambda f: (F.size(at(f)) != 1) | (F.size(F.get(at(f), F.lit(0))["sentences"]) <= f["sentence_index"]) | (f["sentence_index"] < 0))
    rows = _checked(rows, [(bad, F.concat(F.lit("dangling supporting fact in "), key))])
    evidence = F.transform("supporting_facts", lambda f: F.struct(F.get(at(f), F.lit(0))["id"].alias("document_id"), f["sentence_index"].cast("int").alias("sentence_index"), F.get(F.get(at(f), F.lit(0))["sentences"], f["sentence_index"]).alias("text")))
    rows = rows.withColumn("supporting_evidence", evidence)
    rest = F.array_except(F.transform("documents", lambda d: d["id"]), F.transform("supporting_evidence", lambda e: e["document_id"]))
    return rows.select(F.concat(F.lit("hotpotqa:"), key).alias("id"), F.lit("hotpotqa").alias("benchmark_id"), F.col("question").alias("query"), F.array("answer").alias("answers"), F.lit(None).cast("string").alias("label"), F.lit("answerable").alias("answerability"), "documents", "supporting_evidence", rest.alias("distractor_document_ids"))


#: The labels of claims.
FEVER_LABELS = {"SUPPORTS": "supports", "REFUTES": "refutes", "NOT ENOUGH INFO": "not_enough_info"}


def fever(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, label, claim, evidence [[page, sentence]]) and pages (page, sentences) to cases; each evidence set is a vote.

    A claim without enough information has no evidence and is unanswerable. A claim that cites a missing page is left out (see `missing_pages`).
    """
    label = F.create_map(*[F.lit(x) for kv in FEVER_LABELS.items() for x in kv])[F.col("label")]
    nei = F.col("label") == "NOT ENOUGH INFO"
    sets = F.when(nei, F.array().cast("array<array<struct<page:string,sentence:int>>>")).otherwise(F.filter(F.transform("evidence", lambda s: F.filter(F.transform(s, lambda e: F.struct(e["page"].alias("page"), e["sentence"].cast("int").alias("sentence"))), lambda e: e["page"].isNotNull())), lambda s: F.size(s) > 0))
    rows = claims.select(F.col("id").cast("string").alias("key"), "claim", label.alias("label"), nei.alias("nei"), sets.alias("sets"))
    need = rows.select("key", F.explode_outer(F.array_distinct(F.flatten(F.transform("sets", lambda s: F.transform(s, lambda e: e["page"]))))).alias("page"))
    found = need.join(pages.select("page", "sentences"), "page", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("page").isNotNull(), F.struct(F.col("page").alias("title"), "sentences")))).alias("context"), F.count_if(F.col("page").isNotNull() & F.col("sentences").isNull()).alias("missing"))
    rows = rows.join(found, "key").where("missing = 0")
    rows = rows.withColumn("documents", _documents(F.col("context"), "fever", F.col("key"), "page", "page_id"))
    doc = lambda e: F.get(F.filter("documents", lambda d: d["source_title"] == e["page"]), F.lit(0))
    flat = F.array_distinct(F.flatten("sets"))
    evidence = F.transform(flat, lambda e: F.struct(doc(e)["id"].alias("document_id"), e["sentence"].alias("sentence_index"), F.get(doc(e)["sentences"], e["sentence"]).alias("text")))
    votes = F.transform("sets", lambda s: F.transform(s, lambda e: F.struct(doc(e)["id"].alias("document_id"), e["sentence"].alias("sentence_index"))))
    return rows.select(F.concat(F.lit("fever:"), F.col("key")).alias("id"), F.lit("fever").alias("benchmark_id"), F.col("claim").alias("query"), F.array().cast(EMPTY).alias("answers"), "label", F.when(F.col("nei"), "unanswerable").otherwise("answerable").alias("answerability"), "documents", evidence.alias("supporting_evidence"), votes.alias("evidence_sets"))


def missing_pages(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page) of cited pages that are not there."""
    cited = claims.select(F.col("id").cast("string").alias("id"), F.explode(F.array_distinct(F.flatten(F.transform("evidence", lambda s: F.transform(s, lambda e: e["page"]))))).alias("page")).where("page is not null")
    return cited.join(pages.select("page"), "page", "left_anti")


def fever_sentences(lines: Column) -> Column:
    """Numbered, tab-separated lines as a dense array; gaps are empty strings."""
    pairs = F.filter(F.transform(F.split(lines, "\n"), lambda l: F.struct(F.regexp_extract(l, r"^(\d+)\t", 1).try_cast("int").alias("n"), F.get(F.split(l, "\t"), F.lit(1)).alias("s"))), lambda p: p["n"].isNotNull())
    last = F.array_max(F.transform(pairs, lambda p: p["n"]))
    by = F.map_from_entries(pairs)
    return F.when(F.size(pairs) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(by, i), F.lit("")))).otherwise(F.array().cast(EMPTY))


def squad(articles: DataFrame) -> DataFrame:
    """Articles (title, paragraphs [context, qas]) to one row a question."""
    p = articles.select("title", F.explode("paragraphs").alias("p"))
    return p.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q")).select("q.id", "title", "context", "q.question", "q.answers", "q.is_impossible")


def squad_cases(questions: DataFrame) -> DataFrame:
    """Flat questions to cases; an answer that does not stand where it says, or a question both impossible and answered, fails the query."""
    questions = questions.withColumnRenamed("id", "key")
    drift = F.exists("answers", lambda a: F.substring(F.col("context"), a["answer_start"] + 1, F.length(a["text"])) != a["text"])
    rows = _checked(questions, [(drift, F.concat(F.lit("answer is not at its offset in "), F.col("key"))), (F.col("is_impossible") == (F.size("answers") > 0), F.concat(F.lit("impossible and answered, or neither: "), F.col("key")))])
    docs = _documents(F.array(F.struct("title", F.array("context").alias("sentences"))), "squad", F.col("key"))
    texts = F.array_distinct(F.transform("answers", lambda a: a["text"]))
    return rows.select(F.concat(F.lit("squad:"), F.col("key")).alias("id"), F.lit("squad_v2").alias("benchmark_id"), F.col("question").alias("query"), texts.alias("answers"), F.lit(None).cast("string").alias("label"), F.when(F.col("is_impossible"), "unanswerable").otherwise("answerable").alias("answerability"), docs.alias("documents"))


#: Fixed value: how many annotators a question has.
ANNOTATIONS = 5


def natural_questions(records: DataFrame, votes: int = 2) -> DataFrame:
    """Tokens, candidates and five annotations a question to cases.

    A candidate's text is its non-HTML tokens. A question is answerable with `votes` long answers or more. Evidence is the candidates that as many
    annotators chose, or any if none has; answers are short ones with as many votes, else yes or no with as many, else the evidence's texts.
    """
    rows = records.select(F.col("id").alias("key"), F.col("document.title").alias("title"), F.col("question.text").alias("query"), F.col("document.tokens.token").alias("token"), F.col("document.tokens.is_html").alias("is_html"), F.col("long_answer_candidates.start_token").alias("start"), F.col("long_answer_candidates.end_token").alias("end"), F.col("annotations.long_answer").alias("long"), F.col("annotations.short_answers").alias("short"), F.col("annotations.yes_no_answer").alias("yes_no"))
    rows = _checked(rows, [(F.size("long") != ANNOTATIONS, F.concat(F.lit("not five annotations in "), F.col("key"))), (F.size("start") != F.size("end"), F.concat(F.lit("candidate columns differ in length in "), F.col("key"))), (F.size("token") != F.size("is_html"), F.concat(F.lit("token columns differ in length in "), F.col("key")))])
    words = F.arrays_zip("token", "is_html")
    rows = rows.withColumn("words", words)
    text = lambda i: F.array_join(F.transform(F.filter(F.slice("words", F.get("start", i) + 1, F.get("end", i) - F.get("start", i)), lambda w: ~w["is_html"]), lambda w: w["token"]), " ")
    chosen = F.filter(F.transform("long", lambda l: l["candidate_index"]), lambda i: i >= 0)
    rows = rows.withColumn("chosen", chosen)
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    agreed = F.array_sort(F.array_distinct(F.filter("chosen", lambda i: times(F.col("chosen"), i) >= votes)))
    rows = rows.withColumn("evidence", F.when(F.size("chosen") < votes, F.array().cast("array<int>")).when(F.size(agreed) > 0, agreed).otherwise(F.array_sort(F.array_distinct("chosen"))).cast("array<int>"))
    rows = rows.withColumn("texts", F.transform("evidence", text))
    shorts = F.flatten(F.transform("short", lambda s: F.array_distinct(s["text"])))
    rows = rows.withColumn("shorts", shorts)
    short = F.array_distinct(F.filter("shorts", lambda s: times(F.col("shorts"), s) >= votes))
    yes, no = times(F.col("yes_no"), F.lit(1)), times(F.col("yes_no"), F.lit(0))
    answers = F.when(F.size("chosen") < votes, F.array().cast(EMPTY)).when(F.size(short) > 0, short).when(yes >= votes, F.array(F.lit("yes"))).when(no >= votes, F.array(F.lit("no"))).otherwise(F.col("texts"))
    docs = _documents(F.transform(F.sequence(F.lit(0), F.size("start") - 1), lambda i: F.struct(F.col("title").alias("title"), F.array(text(i)).alias("sentences"))), "nq", F.col("key"))
    return rows.select(F.concat(F.lit("nq:"), F.col("key")).alias("id"), F.lit("natural_questions").alias("benchmark_id"), "query", answers.alias("answers"), F.lit(None).cast("string").alias("label"), F.when(F.size("chosen") >= votes, "answerable").otherwise("unanswerable").alias("answerability"), docs.alias("documents"), F.transform("evidence", lambda i: F.concat(F.lit("nq:"), F.col("key"), F.lit(":doc:"), i.cast("string"))).alias("evidence_document_ids"))


def unique_ids(cases: DataFrame, key: str = "id") -> DataFrame:
    """The cases, failing where an id comes twice."""
    w = Window.partitionBy(key)
    return _checked(cases.withColumn("_n", F.count("*").over(w)), [(F.col("_n") > 1, F.concat(F.lit("duplicate id "), F.col(key)))]).drop("_n")


def normalize_many(records: DataFrame, key: str, normalize: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """Records whose ids are there and single, the first `limit` of them in hash order, normalised. Fewer records than the limit are an error."""
    rows = unique_ids(_checked(records, [(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", F.lit(f"record missing {key}"))]), key)
    if limit is None:
        return normalize(rows)
    if limit < 1 or rows.limit(limit).count() < limit:
        raise ValueError("fewer records than asked for")
    return normalize(sampling.hash_sample(rows, limit, key))


def from_columns(rows: DataFrame) -> DataFrame:
    """HotpotQA rows from Parquet, whose facts and contexts are parallel arrays, in the shape that `hotpotqa` takes."""
    facts = F.transform(F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id")), lambda f: F.struct(f["title"].alias("title"), f["sent_id"].cast("int").alias("sentence_index")))
    context = F.transform(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")), lambda c: F.struct(c["title"].alias("title"), c["sentences"].alias("sentences")))
    return rows.select(F.col("id").alias("_id"), "question", "answer", "type", "level", facts.alias("supporting_facts"), context.alias("context"))


def sampled_shards(spark: SparkSession, path: str, key: str, limit: int) -> DataFrame:
    """The first `limit` rows in hash order of a folder of Parquet shards: ids alone are read and ranked, then the rows of those that were drawn."""
    ids = sampling.hash_sample(spark.read.parquet(path).select(key), limit, key)
    return spark.read.parquet(path).join(F.broadcast(ids), key, "left_semi")  # `limit` ids


def compact_natural_questions(rows: DataFrame) -> DataFrame:
    """What a case needs of a source row, and the digest of the whole row's canonical JSON."""
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    tokens, candidates, a = F.col("document.tokens"), F.col("long_answer_candidates"), F.col("annotations")
    document = F.struct(F.col("document.title").alias("title"), F.struct(tokens["token"].alias("token"), tokens["is_html"].alias("is_html")).alias("tokens"))
    marks = F.struct(F.transform(a["long_answer"], lambda l: F.struct(l["candidate_index"].alias("candidate_index"))).alias("long_answer"), F.transform(a["short_answers"], lambda s: F.struct(s["text"].alias("text"))).alias("short_answers"), a["yes_no_answer"].alias("yes_no_answer"))
    return rows.select("id", document.alias("document"), F.struct(F.col("question.text").alias("text")).alias("question"), F.struct(candidates["start_token"].alias("start_token"), candidates["end_token"].alias("end_token")).alias("long_answer_candidates"), marks.alias("annotations"), F.sha2(whole, 256).alias("_source_record_sha256"))


def fever_source(claims: DataFrame, pages: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` claims in hash order whose pages are all there, the claims left out and the pages that they lack). A pool of a twentieth more claims, a hundred at least, is looked at.

    Pages are found by composed titles, since sources differ in how they write letters with marks.
    """
    pool = staged(sampling.hash_sample(claims, limit + max(100, -(-limit // 20)), "id"), "claims")
    cited = pool.select("id", F.explode(F.array_distinct(F.flatten(F.transform("evidence", lambda s: F.transform(s, lambda e: e["page"]))))).alias("page")).where("page IS NOT NULL")
    titles = pages.select(composed(F.col("page")).alias("title")).distinct()
    lost = staged(cited.withColumn("title", composed(F.col("page"))).join(titles, "title", "left_anti").select("id", "page"), "lost")
    kept = pool.join(lost.select("id").distinct(), "id", "left_anti")
    return sampling.hash_sample(kept, limit, "id"), lost.groupBy("id").agg(F.array_sort(F.collect_set("page")).alias("missing_pages"))


def conversion_report(cases: DataFrame, source_count: int) -> DataFrame:
    """(measure, value, n): how many cases came of how many records, and how they are spread over answerability, labels and numbers of documents."""
    spread_ = lambda c, n: cases.groupBy(F.coalesce(c.cast("string"), F.lit("none")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(n).alias("measure"), "value", "n")
    total = cases.agg(F.count("*").alias("n")).select(F.lit("cases").alias("measure"), F.format_string("%.6f of source lost", 1 - F.col("n") / max(source_count, 1)).alias("value"), "n")
    return total.unionByName(spread_(F.col("answerability"), "answerability")).unionByName(spread_(F.col("label"), "label")).unionByName(spread_(F.size("documents"), "documents"))


def child_rows(cases: DataFrame) -> DataFrame:
    """(case_id, document_id, title, text): the candidate documents of each case."""
    return cases.select(F.col("id").alias("case_id"), F.explode("documents").alias("d")).select("case_id", F.col("d.id").alias("document_id"), "d.title", F.array_join("d.sentences", " ").alias("text"))
