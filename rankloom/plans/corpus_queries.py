"""Named queries on corpus preparation, contracts, policies, validation and telemetry, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import anchors, stats
from ..functions import text as tx
from ..operators import contracts, corpus, evidence, metrics, policy, provider, ranking
from ..streaming import telemetry
from .catalogue import _BM25, _DENSE, _TFR, _TOK, _bm25_ranks, _dense_ranks, _labelled, _lexical, _tf_ranks, _vectors, named, table

_NW = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


@named(f"""WITH w AS (SELECT doc_id, {_NW} AS ws FROM documents), c AS (SELECT *, CASE WHEN len(ws) <= 180 THEN 1 ELSE CAST(ceil((len(ws) - 180) / 140) AS INT) + 1 END AS n FROM w WHERE len(ws) > 0),
x AS (SELECT doc_id, ws, unnest(range(0, n)) AS i FROM c) SELECT doc_id, CAST(i AS INT) AS window, len(ws[i * 140 + 1 : i * 140 + 180]) AS n_words, array_to_string(ws[i * 140 + 1 : i * 140 + 180], ' ') AS text FROM x""")
def chunk_windows(spark, d):
    return corpus.windows(table(spark, d, "documents"), "doc_id", F.col("text"))


@named(r"""WITH l AS (SELECT doc_id, unnest(ls) AS value, unnest(range(0, len(ls))) AS line FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM documents)),
f AS (SELECT *, trim(value) <> '' AS full_ FROM l), b AS (SELECT *, sum((full_ AND NOT coalesce(prev, false))::INT) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM (SELECT *, lag(full_) OVER (PARTITION BY doc_id ORDER BY line) AS prev FROM f))
SELECT doc_id, block, min(line) AS start_line, max(line) AS end_line, string_agg(value, chr(10) ORDER BY line) AS text FROM b WHERE full_ GROUP BY doc_id, block""")
def section_segments(spark, d):
    return corpus.paragraphs(table(spark, d, "documents"), "doc_id", F.col("text"))


@named("""WITH h AS (SELECT source, sha256(doc_id || ':' || coalesce(text, '')) AS h FROM documents), b AS (SELECT source, substr(h, 1, 4) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY b)) AS sha256 FROM b GROUP BY source""")
def evidence_fingerprints(spark, d):
    return corpus.fingerprint(table(spark, d, "documents"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), ["source"])


@named(r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9][a-z0-9_.:/-]*')) AS t FROM benchmark),
p AS (SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.t, y.t)) AS i, len(x.t) + len(y.t) AS n FROM t x JOIN t y ON x.item_id < y.item_id)
SELECT a, b, round(i / (n - i), 9) AS jaccard FROM p WHERE i > 0 AND i / (n - i) >= 0.15::DOUBLE""")
def near_duplicate_jaccard(spark, d):
    return corpus.near_pairs(table(spark, d, "benchmark"), "item_id", tx.question_tokens(F.col("text")), 0.15).withColumn("jaccard", F.round("jaccard", 9))


@named()
def lexical_compression(spark, d):
    """Each item's first two documents, cut to 600 characters for it."""
    top = _bm25_ranks(_lexical(spark, d), 2).select("query_id", "doc_id")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, d, "documents").select("doc_id", F.array(F.coalesce("text", F.lit(""))).alias("stored"))
    return ranking.compress(docs.join(top, "doc_id").join(items, "query_id"), "query", "stored", 600, ["query_id", "doc_id"])


_STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@named(f"""WITH t AS (SELECT item_id, {_TOK.format("text")} AS ws FROM benchmark), k AS (SELECT item_id, ws, list_filter(ws, lambda w: length(w) > 2 AND w NOT IN ({_STOPS})) AS kept FROM t)
SELECT item_id, array_to_string(list_sort(list_distinct(CASE WHEN len(kept) > 0 THEN kept ELSE ws[1:8] END)), ' ') AS terms FROM k""")
def fts_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(tx.fts_terms(F.col("text")))), " ").alias("terms"))


@named(r"SELECT DISTINCT source, lang || '::' || regexp_replace(regexp_replace(lower(source || ' & ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS heading_key FROM documents")
def slug_heading_keys(spark, d):
    return table(spark, d, "documents").select("source", tx.heading_key(F.col("lang"), F.concat("source", F.lit(" & "), "lang", F.lit("!"))).alias("heading_key")).distinct()


@named("""WITH dl AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT n_chars / (n_chars + 1000.0::DOUBLE) AS score, quality FROM dl), t AS (SELECT unnest(range(5, 96)) / 100.0::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS kept, count(*) FILTER (WHERE score >= threshold AND quality = 1) AS good, (SELECT count(*) FROM s WHERE quality = 1) AS all_good FROM t, s GROUP BY threshold)
SELECT threshold, kept, good / nullif(kept, 0)::DOUBLE AS precision, good / all_good::DOUBLE AS recall FROM c""")
def threshold_sweep(spark, d):
    """Precision and recall of a fixed score at thresholds from 0.05 to 0.95, from sums by score step: a row meets one step, not 91 thresholds."""
    s = _labelled(spark, d).select((F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"), "quality")
    thresholds = [i / 100.0 for i in range(5, 96)]
    step = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("score") >= t)) - 1
    by = s.select(step.alias("step"), "quality").groupBy("step").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("g"))
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "i int, threshold double")
    total = s.agg(F.count_if(F.col("quality") == 1).alias("all_good"))
    out = grid.join(F.broadcast(by), F.col("step") >= F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"), F.coalesce(F.sum("g"), F.lit(0)).alias("good"))  # 92 rows at most
    return out.crossJoin(F.broadcast(total)).select("threshold", "kept", stats.rate(F.col("good"), F.col("kept")).alias("precision"), stats.rate(F.col("good"), F.col("all_good")).alias("recall"))


@named("SELECT lang, source, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))")
def grouping_sets_summary(spark, d):
    return spark.sql("SELECT lang, source, count(*) AS n, sum(quality) AS good, sum(toxic) AS toxic FROM {rows} GROUP BY GROUPING SETS ((), (lang), (source))", rows=_labelled(spark, d))


@named("""SELECT 'duplicate_document_id' AS rule, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS n
UNION ALL SELECT 'empty_document', (SELECT count(*) FROM documents WHERE trim(coalesce(text, '')) = '')
UNION ALL SELECT 'character_count', (SELECT count(*) FROM documents WHERE length(text) IS DISTINCT FROM n_chars)
UNION ALL SELECT 'label_without_document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'label_out_of_range', (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1))
UNION ALL SELECT 'turn_gap', (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) + 1 <> count(*) OR min(turn) <> 0))
UNION ALL SELECT 'duplicate_text', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1))""")
def validation_violations(spark, d):
    docs, labels, conv = (table(spark, d, t) for t in ("documents", "labels", "conversations"))
    checks = {
        "duplicate_document_id": docs.groupBy("doc_id").count().where("count > 1"),
        "empty_document": docs.where("trim(coalesce(text, '')) = ''"),
        "character_count": docs.where("NOT (length(text) <=> n_chars)"),
        "label_without_document": labels.join(docs.select("doc_id"), "doc_id", "left_anti"),
        "label_out_of_range": labels.where("quality NOT IN (0, 1) OR toxic NOT IN (0, 1)"),
        "turn_gap": conv.groupBy("conv_id").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("*").alias("n")).where("hi + 1 <> n OR lo <> 0"),
        "duplicate_text": docs.groupBy(F.sha2("text", 256)).count().where("count > 1"),
    }
    out = None
    for rule, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@named("""WITH e AS (SELECT conv_id, turn, sha256(conv_id || ':' || turn || ':' || coalesce(text, '')) AS h FROM conversations),
p AS (SELECT *, CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'forged' ELSE lag(h) OVER w END AS named, lag(h) OVER w AS before, row_number() OVER w - 1 AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE turn <> place) AS broken_sequence, count(*) FILTER (WHERE named IS DISTINCT FROM before) AS broken_links FROM p GROUP BY conv_id""")
def hash_chain_check(spark, d):
    """Each conversation as a ledger whose turns name the digest of the turn before; in some the third names another."""
    e = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256).alias("h"))
    before = F.lag("h").over(Window.partitionBy("conv_id").orderBy("turn"))
    e = e.withColumn("named", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 2), "forged").otherwise(before))
    return corpus.hash_chain(e, "conv_id", "turn", "named", "h")


@named("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@named("SELECT 'lang' AS category, coalesce(lang, 'unreported') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'event_type', coalesce(event_type, 'unreported'), count(*) FROM events GROUP BY ALL UNION ALL SELECT 'role', coalesce(role, 'unreported'), count(*) FROM conversations GROUP BY ALL")
def category_histograms(spark, d):
    parts = [(t, c) for t, c in (("documents", "lang"), ("events", "event_type"), ("conversations", "role"))]
    out = None
    for t, c in parts:
        one = table(spark, d, t).groupBy(F.coalesce(c, F.lit("unreported")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("category"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


@named("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), f AS (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE, 1.0::DOUBLE]) AS fraction)
SELECT fraction, value FROM f JOIN r ON i = round_even((n - 1) * fraction, 0)""")
def latency_percentiles_nearest(spark, d):
    return metrics.nearest_rank_percentiles(table(spark, d, "events"), "value", (0.0, 0.5, 0.95, 0.99, 1.0))


@named("SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(median(value), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, max(value) AS highest FROM events GROUP BY event_type")
def latency_percentiles_linear(spark, d):
    e = table(spark, d, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.max("value").alias("highest"))
    at = lambda f: F.round(F.max(F.when(F.col("fraction") == f, F.col("value"))), 9)
    p = metrics.linear_percentiles(e, "value", (0.5, 0.95, 0.99), ["event_type"]).groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return sums.join(p, "event_type")


@named("SELECT event_type, key, count(*) AS calls, sum(v)::BIGINT AS total FROM (SELECT event_type, unnest(json_keys(props)) AS key, (json_extract(props, '$.k'))::BIGINT AS v FROM events) GROUP BY ALL")
def usage_merge(spark, d):
    e = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("calls"), F.sum("v").alias("total"))


@named(f"""WITH {_BM25}, {_TFR}, {_DENSE.replace("qv AS", "qv AS").strip()}, s AS (SELECT query_id, source AS a FROM bmr WHERE rank = 1), t AS (SELECT tfr.query_id, d.source AS a FROM tfr JOIN documents d USING (doc_id) WHERE rank = 1), u AS (SELECT query_id, source AS a FROM bmr WHERE rank = 2),
v AS (SELECT 'primary' AS run, * FROM s UNION ALL SELECT 'second', * FROM t UNION ALL SELECT 'third', * FROM u),
b AS (SELECT query_id, a, count(*) AS votes FROM v GROUP BY ALL), m AS (SELECT query_id, max({{'votes': votes, 'a': a}}) AS best FROM b GROUP BY query_id), n AS (SELECT query_id, count(*) AS n_runs, max(a) FILTER (WHERE run = 'primary') AS own FROM v GROUP BY query_id)
SELECT query_id, CASE WHEN best.votes * 2 > n_runs THEN best.a ELSE own END AS answer, best.votes AS votes, n_runs FROM m JOIN n USING (query_id)""")
def ensemble_majority(spark, d):
    """Three runs vote on the source of an item's best document; without a majority the first run decides."""
    found = _lexical(spark, d)
    two = _bm25_ranks(found, 2)
    v = two.where("rank = 1").select(F.lit("primary").alias("run"), "query_id", F.col("source").alias("answer"))
    v = v.unionByName(_tf_ranks(found, 1).select(F.lit("second").alias("run"), "query_id", F.col("source").alias("answer")))
    v = v.unionByName(two.where("rank = 2").select(F.lit("third").alias("run"), "query_id", F.col("source").alias("answer")))
    return policy.majority(v, "query_id", "run", "answer", "primary")


@named("""WITH v AS (SELECT doc_id, CASE quality WHEN 1 THEN 'accept' ELSE 'reject' END AS a, CASE toxic WHEN 0 THEN 'accept' ELSE 'reject' END AS b, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'reject' ELSE 'accept' END AS c FROM labels)
SELECT doc_id, CASE WHEN a = b THEN a WHEN c = 'accept' THEN CASE WHEN (a = 'accept')::INT + (b = 'accept')::INT + 1 >= 2 THEN 'accept' ELSE 'fail_closed' END WHEN c IS NOT NULL THEN c ELSE 'fail_closed' END AS decision FROM v""")
def cascade_resolve(spark, d):
    v = table(spark, d, "labels")
    a, b = F.when(F.col("quality") == 1, "accept").otherwise("reject"), F.when(F.col("toxic") == 0, "accept").otherwise("reject")
    c = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, "reject").otherwise("accept")
    return v.select("doc_id", policy.resolve(a, b, c).alias("decision"))


@named("""WITH t AS (SELECT *, NOT regexp_matches(coalesce(text, ''), '\\S') AS blank FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, array_to_string(CASE WHEN conv_id % 5 = 4 THEN ['root_type'] ELSE list_filter([CASE WHEN conv_id % 5 = 3 THEN 'nonanswer_response' END, CASE WHEN conv_id % 5 = 3 THEN 'nonanswer_with_claims' END,
  CASE WHEN conv_id % 5 = 1 THEN 'claim_order' END, CASE WHEN blank THEN 'claim_text' END, CASE WHEN conv_id % 5 = 2 THEN 'nonexistent_citation' END], lambda x: x IS NOT NULL) END, ',') AS violations FROM t""")
def structured_answer_validation(spark, d):
    """Assistant turns as answers of varied form, checked against the contract."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    claim = F.struct(F.when(F.col("conv_id") % 5 == 1, "c2").otherwise("c1").alias("id"), F.col("text").alias("text"), F.when(F.col("conv_id") % 5 == 2, F.array(F.lit("S9"))).otherwise(F.array(F.lit("S1"))).alias("citation_ids"))
    answer = F.to_json(F.struct(F.lit(contracts.VERSION).alias("schema_version"), F.when(F.col("conv_id") % 5 == 3, "abstain_absent").otherwise("answer").alias("action"), F.lit(None).cast("string").alias("response"), F.array(claim).alias("claims")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("conv_id") % 5 == 4, F.concat(F.lit("Here: "), answer)).otherwise(answer)
    rows = c.select("conv_id", "turn", raw.alias("raw"))
    return rows.select("conv_id", "turn", F.array_join(contracts.violations(F.col("raw"), F.array(F.lit("S1"), F.lit("S2"))), ",").alias("violations"))


@named("""WITH c AS (SELECT conv_id, turn, turn // 4 AS pair, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id, pair, to_json({'results': list({'case_id': 'case-' || conv_id || '-' || turn, 'citation_ids': ['D1'], 'prediction': text} ORDER BY turn)})::VARCHAR AS good,
  string_agg(CASE WHEN NOT regexp_matches(text, '\\S') THEN 'case-' || conv_id || '-' || turn || ': empty_prediction' END, ',' ORDER BY turn) AS bad FROM c GROUP BY ALL)
SELECT conv_id, pair::INT AS pair, CASE WHEN conv_id % 5 <> 4 THEN good END AS value, CASE conv_id % 5 WHEN 1 THEN 'stripped_markdown_fence' WHEN 2 THEN 'restored_missing_root_closer' WHEN 3 THEN 'stripped_extra_trailing_closer' ELSE '' END AS events,
  CASE WHEN conv_id % 5 = 4 THEN 'invalid_json' END AS error, CASE WHEN conv_id % 5 = 4 THEN 'invalid_json' ELSE coalesce(bad, '') END AS violations FROM g""")
def provider_json_repair(spark, d):
    """Pairs of assistant turns as a model might return them for a batch of two, repaired and validated; every repair is named."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select((F.col("turn") / 4).cast("int").alias("pair"), "conv_id", "turn", "text")
    case = F.concat(F.lit("case-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    result = F.struct(case.alias("case_id"), F.coalesce("text", F.lit("")).alias("prediction"), F.array(F.lit("D1")).alias("citation_ids"))
    rows = c.groupBy("conv_id", "pair").agg(F.sort_array(F.collect_list(F.struct("turn", result.alias("r"), F.struct(case.alias("case_id"), F.lit("hotpotqa").alias("benchmark_id"), F.array(F.lit("D1"), F.lit("D2")).alias("citation_ids")).alias("b")))).alias("x"))
    rows = rows.select("conv_id", "pair", F.col("x.b").alias("batch"), F.concat(F.lit('{"results":'), F.to_json("x.r"), F.lit("}")).alias("good"))
    k = F.col("conv_id") % 5
    raw = F.when(k == 1, F.concat(F.lit("```json\n"), "good", F.lit("\n```"))).when(k == 2, F.regexp_replace("good", r"\}$", "")).when(k == 3, F.concat("good", F.lit("}"))).when(k == 4, F.concat(F.lit("So: "), "good")).otherwise(F.col("good"))
    out = provider.audited(rows.withColumn("raw", raw), "raw", "batch")
    return out.select("conv_id", "pair", F.col("repaired.value").alias("value"), F.array_join("repaired.events", ",").alias("events"), F.col("repaired.error").alias("error"), F.array_join("repaired.violations", ",").alias("violations"))


@named("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS highest FROM events GROUP BY ALL")
def streaming_telemetry_windows(spark, d):
    """Tumbling windows by Structured Streaming over the event table, to the end of what is there."""
    return telemetry.run_windows(spark, f"{d}/events.parquet", "1 hour")


@named("""WITH e AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events), s AS (SELECT *, sum((gap IS NULL OR gap > INTERVAL '30 minutes')::INT) OVER (PARTITION BY user_id ORDER BY ts, gap NULLS FIRST) AS session FROM e)
SELECT user_id, session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM s GROUP BY ALL""")
def user_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("new", (gap.isNull() | (gap > 1_800_000_000)).cast("int"))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@named("WITH e AS (SELECT event_type, max_by({'event_id': event_id, 'value': value}, {'ts': ts, 'i': event_id}) AS l FROM events GROUP BY event_type) SELECT event_type, l.event_id AS event_id, l.value AS value FROM e")
def last_record_wins(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return policy.latest(e, "event_type", "at").select("event_type", "event_id", "value")


@named("""WITH r AS (SELECT conv_id, turn, CAST(ceil(octet_length(encode(coalesce(text, ''))) / 3) AS BIGINT) + 64 AS tokens FROM conversations) SELECT conv_id, sum(tokens)::BIGINT AS tokens, max(tokens) AS largest FROM r GROUP BY conv_id""")
def prompt_token_estimate(spark, d):
    r = table(spark, d, "conversations").select("conv_id", tx.prompt_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return r.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


@named()
def request_shards(spark, d):
    """Greedy order-preserving shards of each role's turns, by count and size."""
    c = table(spark, d, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("request"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    return policy.shards(c, "request", F.col("bytes"), 50, 20_000, "role")


@named("SELECT l.query_id, count(*) AS n, count(*) FILTER (WHERE label = ql) AS relevant, round(avg(score) FILTER (WHERE label = ql), 6) AS mean_relevant FROM (" + f"WITH {_DENSE} SELECT * FROM der WHERE rank <= 20" + ") l GROUP BY l.query_id")
def dense_label_purity(spark, d):
    t = _dense_ranks(spark, d, 20)
    same = F.col("label") == F.col("ql")
    return t.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(same).alias("relevant"), F.round(F.avg(F.when(same, F.col("score"))), 6).alias("mean_relevant"))


@named(f"WITH {_DENSE}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) = 1 AS first FROM der WHERE rank <= 60), s AS (SELECT *, sum(first::INT) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM f) SELECT query_id, CAST(min(rank) FILTER (WHERE seen >= 5) AS INT) AS raw_needed FROM s GROUP BY query_id")
def distinct_prefix_length(spark, d):
    """How many vectors hold five distinct labels, by each label's first rank in the whole ranking."""
    q, v = _vectors(spark, d)
    first = ranking.dense_first_ranks(q, v, "label").withColumnRenamed("label", "heading")
    return evidence.distinct_prefix(first, 5)


@named(f"WITH {_BM25}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, rank) AS r FROM bmr WHERE rank <= 6) SELECT query_id AS case_id, arg_min(doc_id, rank) AS \"left\", arg_max(doc_id, rank) AS \"right\", round(sum(round(score, 6)), 6) AS score FROM t WHERE r <= 2 GROUP BY query_id HAVING count(*) = 2")
def best_document_pair(spark, d):
    s = _bm25_ranks(_lexical(spark, d), 6).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("document_id"), F.col("rank").alias("position"), F.round("score", 6).alias("score"))
    return evidence.best_pair(s).withColumn("score", F.round("score", 6))


@named(f"WITH {_BM25} SELECT query_id, CASE WHEN round(score, 6) < 60 THEN 'not enough information' ELSE doc_id::VARCHAR END AS prediction, CASE WHEN round(score, 6) < 60 THEN 0 ELSE 1 END AS n_citations FROM bmr WHERE rank = 1")
def abstention_by_threshold(spark, d):
    p = _bm25_ranks(_lexical(spark, d), 1).select("query_id", F.round("score", 6).alias("s"), F.col("doc_id").cast("string").alias("prediction"), F.array(F.col("doc_id").cast("string")).alias("citations"))
    return evidence.abstain_below(p, F.col("s"), 60.0, "not enough information").select("query_id", "prediction", F.size("citations").alias("n_citations"))


@named()
def lost_anchors(spark, d):
    """Exact anchors of each user turn that the answer after it lacks."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = u.join(a, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.array_join(anchors.missing_anchors(F.col("question"), F.col("answer")), " ").alias("missing"), tx.loses_negation(F.col("question"), F.col("answer")).alias("lost_negation"))
