"""Named queries on text functions, records of cases, gates and life cycles, with their DuckDB SQL.

Turns of conversations stand for answers and records, documents for cases and their evidence, labels for judges' and people's decisions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as tx
from ..operators import audits, cases, contracts, corpus, freezes, gates, judging, lifecycle, rechecks, scoring, selectors
from .catalogue import named, table

_FOLD = "replace(lower({0}), 'ß', 'ss')"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = r"regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"


# text functions


@named(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]+'))), ' ') AS words FROM conversations")
def alnum_token_sets(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(tx.alnum_tokens(F.col("text"))), " ").alias("words"))


@named(f"SELECT doc_id, sha256({_FOLD.format(f'''regexp_replace(regexp_replace(nfc_normalize(text), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')''')}) AS sha256 FROM documents")
def normalized_texts(spark, d):
    """Whole texts, composed, folded, with single spaces."""
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.normalized_text(F.col("text")), 256).alias("sha256"))


@named("SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})) AS sha256 FROM documents")
def canonical_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.canonical_sha256({c: F.col(c) for c in ("source", "doc_id", "lang", "n_chars")}).alias("sha256"))


@named("SELECT conv_id, array_to_string(list_transform(range(1, count(*) + 1), lambda x: 'S' || x), ' ') AS ids FROM conversations GROUP BY conv_id")
def namespaced_ids(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return turns.select("conv_id", F.array_join(tx.namespaced_ids("S", F.col("n")), " ").alias("ids"))


@named("SELECT a.doc_id, levenshtein(a.source || a.lang, b.source || b.lang) = 1 AS near FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def one_edit_neighbours(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", "lang").alias("name"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name").alias("next"))
    return docs.join(after, "doc_id").select("doc_id", tx.one_edit_apart(F.col("name"), F.col("next")).alias("near"))


@named("SELECT conv_id, turn, conv_id % 3 = 0 OR contains(lower(text), 'enough information') AS abstains FROM conversations")
def abstentions(spark, d):
    said = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" There is not ENOUGH Information."))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.is_abstention(said).alias("abstains"))


@named("""WITH v AS (SELECT doc_id, doc_id % 3 AS a, doc_id % 13 AS b, doc_id % 7 AS c, CASE doc_id % 4 WHEN 0 THEN 'rc1' WHEN 1 THEN 'beta' ELSE '' END AS pre FROM documents)
SELECT a || '.' || b || '.' || c || CASE pre WHEN '' THEN '' ELSE '-' || pre END AS version, dense_rank() OVER (ORDER BY a, b, c, (pre = '')::INT, pre) AS place, count(*) AS n FROM v GROUP BY a, b, c, pre""")
def semver_order(spark, d):
    """Versions made of ids, numbered in their order."""
    i = F.col("doc_id")
    pre = F.when(i % 4 == 0, "-rc1").when(i % 4 == 1, "-beta").otherwise("")
    versions = table(spark, d, "documents").select(F.concat((i % 3).cast("string"), F.lit("."), (i % 13).cast("string"), F.lit("."), (i % 7).cast("string"), pre).alias("version")).groupBy("version").agg(F.count("*").alias("n"))
    order = Window.orderBy(tx.semver_key(F.col("version")))  # at most 3 x 13 x 7 x 3 versions
    return versions.select("version", F.dense_rank().over(order).alias("place"), "n")


@named("SELECT event_id, strftime(date_trunc('second', ts) - CASE event_id % 3 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL 2 HOUR ELSE -INTERVAL 330 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_timestamps(spark, d):
    """Times of events with and without a zone."""
    zone = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("-05:30")
    return table(spark, d, "events").select("event_id", tx.utc_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)).alias("at"))


@named("SELECT vec_id, round(1 / (1 + exp(-greatest(-700, least(700, 4 * embedding[1]::DOUBLE - 3 * embedding[2]::DOUBLE + 0.5 * embedding[3]::DOUBLE + 0.25)))), 9) AS p FROM embeddings")
def logistic_scores(spark, d):
    x = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(selectors.logistic(x, [4.0, -3.0, 0.5], 0.25), 9).alias("p"))


@named("SELECT doc_id, 'rag-' || substr(sha256(source || ':' || doc_id), 1, 24) AS custom_id FROM documents")
def custom_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.stable_custom_id(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("custom_id"))


@named("""WITH e AS (SELECT conv_id, list(DISTINCT role || '::' || turn) AS r, bool_or(role = 'system') AS has_system FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN has_system THEN 'legacy-v1-evidence::' || substr(sha256(to_json(list_sort(r))), 1, 16) ELSE 'legacy-v1-unanswerable::' || conv_id END AS cluster FROM e""")
def evidence_clusters(spark, d):
    """The cluster of each conversation's turns; those without a system turn stand alone."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.concat("role", F.lit("::"), F.col("turn").cast("string"))).alias("r"), F.bool_or(F.col("role") == "system").alias("some"))
    return rows.select("conv_id", tx.evidence_cluster(F.col("some"), F.col("conv_id").cast("string"), F.col("r")).alias("cluster"))


@named("SELECT source, CASE WHEN count(quality) = 0 THEN 'n/a' ELSE printf('%.1f%%', avg(quality) * 100) END AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def percent_labels(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.avg("quality").alias("r"))
    return rows.select("source", tx.percent(F.col("r")).alias("good"))


@named(r"SELECT doc_id, doc_id % 3 <> 2 AS ok FROM documents WHERE contains(text, chr(10)) AND NOT contains(text, chr(13))")
def checkout_hashes(spark, d):
    """Texts whose lines end in CRLF, against the digest of the same text with LF, with CRLF, and of another text."""
    rows = table(spark, d, "documents").where(F.contains("text", F.lit("\n")) & ~F.contains("text", F.lit("\r")))
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    claim = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2(crlf, 256)).otherwise(F.sha2(F.concat("text", F.lit("!")), 256))
    return rows.select("doc_id", tx.matches_checkout(crlf, claim).alias("ok"))


@named("SELECT doc_id, strpos(lower(text), lower(substr(text, 30, 12))) - 1 AS start, substr(text, strpos(lower(text), lower(substr(text, 30, 12))), 12) AS answer FROM documents WHERE length(text) > 60")
def answer_spans(spark, d):
    """Where a piece of a text, in capitals, stands in it first."""
    rows = table(spark, d, "documents").where(F.length("text") > 60)
    found = tx.find_answer(F.col("text"), F.array(F.upper(F.substring("text", 30, 12)), F.lit("no such answer\u0001"), F.lower(F.substring("text", 30, 12)), F.substring("text", 30, 12)))
    return rows.select("doc_id", found["start"].cast("long").alias("start"), found["answer"].alias("answer"))


@named(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?m)[ \t\x0b\f\r]+$', '', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) AS sha256 FROM documents")
def trimmed_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.trimmed_block(F.col("text")), 256).alias("sha256"))


@named(r"WITH n AS (SELECT event_id, regexp_extract(event_type || ' scored ' || (event_id % 40 - 12) || ' of 10', '(-?\d+)', 1) AS x FROM events) SELECT event_id, least(greatest(x::BIGINT, 0), 10) AS score FROM n")
def judge_integers(spark, d):
    said = F.concat("event_type", F.lit(" scored "), (F.col("event_id") % 40 - 12).cast("string"), F.lit(" of 10"))
    return table(spark, d, "events").select("event_id", tx.judge_integer(said).alias("score"))


@named(f"""WITH t AS (SELECT item_id, regexp_extract_all({_FOLD.format('text')}, '[\\pL\\pN_]+') AS ws FROM benchmark), k AS (SELECT item_id, ws, list_filter(ws, lambda w, i: length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in tx.STOPWORDS)}) AND list_position(ws, w) = i) AS kept FROM t)
SELECT item_id, '"' || array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ws[1:8] END, '" OR "') || '"' AS expression FROM k""")
def quoted_expressions(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.fts_expression(tx.fts_terms(F.col("text"))).alias("expression"))


@named(f"SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN 'no answer' ELSE regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') || ' ' || role END AS answer FROM conversations")
def rendered_answers(spark, d):
    """Turns as structured answers of two claims, or abstentions, written as JSON, parsed and rendered."""
    claims = F.array(*[F.struct(F.lit(i).alias("id"), t.alias("text"), F.array(F.lit("S1")).alias("citation_ids")) for i, t in (("c1", F.col("text")), ("c2", F.concat("role", F.lit(" "))))])
    no = F.col("conv_id") % 4 == 3
    answer = F.struct(F.lit(contracts.VERSION).alias("schema_version"), F.when(no, "abstain_absent").otherwise("answer").alias("action"), F.when(no, " no answer").alias("response"), F.when(no, F.slice(claims, 1, 0)).otherwise(claims).alias("claims"))
    raw = F.to_json(answer, {"ignoreNullFields": "false"})
    return table(spark, d, "conversations").select("conv_id", "turn", contracts.render(contracts.parse(raw)).alias("answer"))


@named("SELECT conv_id, string_agg('[S' || n || '] (' || role || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def rendered_contexts(spark, d):
    """A conversation's turns as numbered sources."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.lit(None).cast("string").alias("id"), F.concat("role", F.lit("::"), F.col("turn").cast("string")).alias("heading_key"), F.col("role").alias("heading"), "text", F.lit(1.0).alias("score"))
    return contracts.context_sources(rows, "conv_id", "turn").select("conv_id", contracts.format_sources(F.col("sources")).alias("context"))


# sections

_SECTIONS = rf"""ls AS (SELECT doc_id, {_LINES} AS l FROM documents), lt AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM ls),
ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM lt), lk AS (SELECT * FROM ln WHERE NOT starts_with(line, '<!--')),
lf AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, coalesce(sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM lk),
lh AS (SELECT *, NOT inside AND NOT fence AND regexp_matches(line, '^#{{1,4}}\s+') AS head FROM lf),
lc AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM lh),
sx AS (SELECT doc_id, section::INT AS section, coalesce(max(CASE WHEN head THEN regexp_replace(regexp_replace(line, '^#{{1,4}}\s+', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') END), 'intro') AS heading,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM lc GROUP BY ALL)"""


@named(rf"WITH {_SECTIONS} SELECT doc_id, section, heading, doc_id || '::' || regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS heading_key, text FROM sx WHERE text <> ''")
def document_sections(spark, d):
    """Sections of all documents."""
    return corpus.sections(table(spark, d, "documents"), "doc_id", F.col("text"))


# fences by the parity of their marks, depths of headings by running least values, blocks by the number of lines that begin one
_BLOCKS = rf"""ls AS (SELECT doc_id, {_LINES} AS l FROM documents), lt AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM ls),
ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM lt),
b0 AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') = '' AS bare FROM ln),
b1 AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM b0),
b2 AS (SELECT *, CASE WHEN NOT inside AND NOT fence AND regexp_matches(line, '^#{{1,4}}\s+') THEN length(regexp_extract(line, '^(#{{1,4}})\s', 1)) END AS level, regexp_replace(regexp_replace(line, '^#{{1,4}}\s+', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t FROM b1),
b3 AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM b2),
b4 AS (SELECT *, CASE WHEN k > 0 THEN least(k, k + min(level - k) OVER (PARTITION BY doc_id ORDER BY n)) ELSE 0 END AS depth FROM b3),
b5 AS (SELECT *, [{', '.join(f"last_value(CASE WHEN level IS NOT NULL AND depth = {d} THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for d in range(1, 5))}] AS p,
  NOT inside AND bare AS blank, NOT inside AND regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s+') AS item, regexp_matches(line, '^[ \t]') AS indented FROM b4),
b6 AS (SELECT *, CASE WHEN depth > 0 THEN p[1:depth] ELSE ['intro'] END AS path, coalesce(lag(blank OR level IS NOT NULL OR (inside AND fence)) OVER (PARTITION BY doc_id ORDER BY n), true) AS free FROM b5),
b7 AS (SELECT *, coalesce(last_value(CASE WHEN item OR NOT indented OR free THEN item END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS of_item FROM b6),
b8 AS (SELECT *, sum((level IS NOT NULL OR (NOT inside AND NOT blank AND (free OR fence OR item OR (of_item AND NOT indented))))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS number FROM b7),
b9 AS (SELECT doc_id, number, min(n)::INT AS start_line, max(n)::INT AS end_line, max(CASE WHEN level IS NOT NULL THEN t END) AS title, arg_min(path, n) AS path,
  regexp_replace(string_agg(regexp_replace(line, '{_SPACE}+$', ''), chr(10) ORDER BY n), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS body FROM b8 WHERE NOT blank GROUP BY doc_id, number),
ba AS (SELECT *, coalesce(title, body) AS text FROM b9),
bb AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1)::INT AS block, split_part(text, chr(10), 1) AS one, split_part(text, chr(10), 2) AS two,
  doc_id || '::' || regexp_replace(regexp_replace(lower(path[-1]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '::span-' || substr(sha256(text), 1, 16) AS base FROM ba WHERE title IS NOT NULL OR (text <> '' AND NOT starts_with(text, '<!--'))),
bc AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY block) AS again FROM bb)"""


@named(rf"""WITH {_BLOCKS} SELECT doc_id, block, base || CASE WHEN again > 1 THEN '-' || again ELSE '' END AS evidence_id, array_to_string(path, ' > ') AS path,
CASE WHEN title IS NOT NULL THEN 'heading' WHEN regexp_matches(one, '^\s*(```|~~~)') THEN 'code' WHEN regexp_matches(one, '^\s*>') THEN 'quote' WHEN regexp_matches(one, '^\s*(?:[-*+]|\d+[.)])\s+') THEN 'list'
  WHEN contains(one, '|') AND regexp_matches(two, '\|?\s*:?-{{3,}}') THEN 'table' ELSE 'prose' END AS block_type, start_line, end_line, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> ''))::INT AS word_count FROM bc""")
def evidence_blocks(spark, d):
    """Blocks of evidence of all documents, with the headings above them."""
    b = corpus.blocks(table(spark, d, "documents"), "doc_id", F.col("text"))
    return b.select("doc_id", "block", "evidence_id", F.array_join("heading_path", " > ").alias("path"), "block_type", "start_line", "end_line", "word_count")


# cases: documents as evidence of conversations' questions

_CASES = """cs AS (SELECT conv_id AS id, 'q' || conv_id AS question, conv_id % 4 <> 3 AS answerable, CASE WHEN conv_id % 4 <> 3 THEN list_sort(list(DISTINCT 'd' || (conv_id + turn) % 50 || '::' || role)) ELSE [] END AS relevant, 'a' || conv_id AS answer FROM conversations GROUP BY conv_id)"""


def _old_cases(spark, d):
    yes = F.col("conv_id") % 4 != 3
    name = F.concat(F.lit("d"), ((F.col("conv_id") + F.col("turn")) % 50).cast("string"), F.lit("::"), "role")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(name)).alias("r"))
    i = F.col("conv_id").cast("string")
    rows = rows.select(i.alias("id"), F.concat(F.lit("q"), i).alias("question"), yes.alias("answerable"), F.when(yes, F.col("r")).otherwise(F.array().cast("array<string>")).alias("relevant"), F.concat(F.lit("a"), i).alias("answer"))
    return rows.withColumn("raw", F.concat_ws("|", "id", "question"))


@named(f"""WITH {_CASES} SELECT 'v1-' || id AS id, CASE WHEN answerable THEN 'legacy_v1_answerable' ELSE 'legacy_v1_unanswerable' END AS lane, CASE WHEN answerable THEN 'answer' ELSE 'abstain_absent' END AS answer_action,
array_to_string(list_concat(['legacy_v1', 'human_authored'], list_sort(list_distinct(list_transform(relevant, lambda r: split_part(r, '::', 1))))), ' ') AS tags, answerable::INT AS reasoning_hops,
CASE WHEN answerable THEN 'legacy-v1-evidence::' || substr(sha256(to_json(relevant)), 1, 16) ELSE 'legacy-v1-unanswerable::' || id END AS evidence_cluster_id, sha256(id || '|' || question) AS source_record_sha256, CASE WHEN answerable THEN 1 ELSE 0 END AS n_claims FROM cs""")
def migrated_cases(spark, d):
    rows = cases.migrate(_old_cases(spark, d), "2.0.0")
    return rows.select("id", "lane", "answer_action", F.array_join("tags", " ").alias("tags"), "reasoning_hops", "evidence_cluster_id", "source_record_sha256", F.size("required_claims").alias("n_claims"))


@named(f"WITH {_CASES} SELECT id::VARCHAR AS id FROM cs WHERE id % 11 = 5")
def migration_drift(spark, d):
    """Records that their cases do not give back: some cases were changed since."""
    old = _old_cases(spark, d)
    new = cases.migrate(old, "2.0.0").withColumn("question", F.when(F.substring("id", 4, 20).cast("long") % 11 == 5, "changed").otherwise(F.col("question")))
    return cases.migration_drift(new, old)


@named(f"WITH {_CASES} SELECT split_part(e, '::', 1) AS document, count(*) AS n FROM (SELECT unnest(relevant) AS e FROM cs) GROUP BY document")
def document_label_counts(spark, d):
    return cases.document_labels(cases.migrate(_old_cases(spark, d), "2.0.0"))


_REASONS = ["absent_from_corpus", "ambiguous", "subjective", "conflicting_sources", None]
_ACTIONS = ["answer", "abstain_absent", "clarify_ambiguous", "abstain_conflict", "abstain_obsolete", "reject_injection"]


@named(f"""WITH r AS (SELECT doc_id, [{', '.join(f"'{a}'" for a in _ACTIONS)}][doc_id % 6 + 1] AS action, [{', '.join('NULL' if r is None else f"'{r}'" for r in _REASONS)}][doc_id % 5 + 1] AS current FROM documents),
a AS (SELECT unnest([{', '.join(f"'{k}'" for k in cases.ACTION_REASONS)}]) AS action, unnest([{', '.join('[' + ', '.join(f"'{x}'" for x in v) + ']' for v in cases.ACTION_REASONS.values())}]) AS allowed)
SELECT doc_id, CASE WHEN action <> 'answer' THEN CASE WHEN coalesce(list_contains(allowed, current), false) THEN current ELSE allowed[1] END END AS reason FROM r LEFT JOIN a USING (action)""")
def repaired_reasons(spark, d):
    """Reasons of abstentions that fit their actions, or the action's default."""
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    current = F.element_at(F.array(*map(F.lit, _REASONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", cases.unanswerable_reason(action, current).alias("reason"))


@named("SELECT conv_id, turn, 'C' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS wire_id FROM conversations")
def wire_ids(spark, d):
    return cases.wire_ids(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@named("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND source IN ('src1', 'src2', 'src12')")
def eligible_cases(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("doc_id").alias("id"), F.col("source").alias("lane"), F.when(F.col("quality") == 1, "approved").otherwise("pending").alias("review_status"))
    return cases.eligible(rows, ["src1", "src2", "src12"]).select("doc_id")


@named("""WITH c AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN toxic = 1 THEN 'rejected' ELSE 'pending' END AS review_status, source, lang FROM documents JOIN labels USING (doc_id))
SELECT review_status, count(*) AS cases, count(DISTINCT source) AS intents, count(DISTINCT lang) AS clusters, (SELECT bool_and(review_status = 'approved') FROM c) AS ready FROM c GROUP BY review_status""")
def review_inventory(spark, d):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("toxic") == 1, "rejected").otherwise("pending")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(status.alias("review_status"), F.col("source").alias("intent_family_id"), F.col("lang").alias("evidence_cluster_id"))
    return cases.inventory(rows)


# gates: two runs over the labelled documents, one right where quality is 1, the other where toxic is 0

_RUNS = "ru AS (SELECT doc_id, source, lang, quality = 1 AS a, toxic = 0 AS b FROM documents JOIN labels USING (doc_id))"


def _runs(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "source", "lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))


_MEANS = "ma AS (SELECT lang AS metric, avg(a::INT) AS a, avg(b::INT) AS b FROM ru GROUP BY lang)"


def _means(spark, d):
    means = _runs(spark, d).groupBy(F.col("lang").alias("metric")).agg(F.avg(F.col("a").cast("int")).alias("a"), F.avg(F.col("b").cast("int")).alias("b"))
    return means.select("metric", F.col("a").alias("value")), means.select("metric", F.col("b").alias("value"))


_DECIDE = "CASE WHEN d >= -t THEN 'PROMOTE' WHEN hard THEN 'REJECT' WHEN d >= -2 * t THEN 'NEEDS_REVIEW' ELSE 'REJECT' END"


@named(f"WITH {_RUNS}, {_MEANS}, x AS (SELECT metric, round(a, 9) AS baseline, round(b, 9) AS candidate, round(b - a, 3) AS d, metric = 'en' AS hard, greatest(0.05, 1.5 / 20) AS t FROM ma) SELECT metric, baseline, candidate, d AS delta, {_DECIDE} AS decision FROM x")
def golden_gate(spark, d):
    """Means by language of two runs as metrics; one of them is hard."""
    out = gates.golden_gate(*_means(spark, d), n_answerable=20, n=30, hard=("en",))
    return out.select("metric", F.round("baseline", 9).alias("baseline"), F.round("candidate", 9).alias("candidate"), "delta", "decision")


@named(f"WITH {_RUNS}, {_MEANS}, x AS (SELECT metric, b - a AS d, false AS hard, 0.005 AS t FROM ma) SELECT metric, {_DECIDE} AS decision FROM x")
def retrieval_gate(spark, d):
    return gates.retrieval_gate(*_means(spark, d)).select("metric", "decision")


@named(f"WITH {_RUNS} SELECT avg(a::INT) >= 0.85 AND avg((a AND b)::INT) >= 0.85 AND count(*) FILTER (NOT b) = 0 AS passes, round(avg(a::INT), 9) AS exact, round(avg((a AND b)::INT), 9) AS f1 FROM ru")
def reader_gate(spark, d):
    rows = _runs(spark, d).select(F.col("a").cast("double").alias("answer_exact_match"), (F.col("a") & F.col("b")).cast("double").alias("answer_f1"), (~F.col("b")).alias("fail_closed"))
    return gates.reader_gate(rows).select("passes", F.round("exact", 9).alias("exact"), F.round("f1", 9).alias("f1"))


@named(f"WITH {_RUNS}, {_MEANS} SELECT metric, round(a, 9) AS expected, round(b, 9) AS actual, abs(b - a) <= 0.02 AS ok FROM ma")
def reproducibility_gate(spark, d):
    out = gates.reproducible(*_means(spark, d))
    return out.select("metric", F.round("expected", 9).alias("expected"), F.round("actual", 9).alias("actual"), "ok")


@named("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(role ORDER BY turn DESC) AS b FROM conversations GROUP BY conv_id) SELECT 'q' || conv_id AS question, CASE WHEN conv_id % 2 = 0 THEN true ELSE a = b END AS ok FROM t""")
def service_parity(spark, d):
    """The roles of a conversation offline, and in a service that turns every second one around."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    rows = rows.select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question"), F.col("conv_id"), F.col("r")["role"].alias("ids"))
    service = rows.select("question", F.when(F.col("conv_id") % 2 == 0, F.col("ids")).otherwise(F.reverse("ids")).alias("ids"))
    return gates.service_parity(rows.select("question", "ids"), service, rows.select("question", "ids"))


@named(f"""WITH {_RUNS}, x AS (SELECT count(*) FILTER (b AND NOT a) AS wins, count(*) FILTER (a AND NOT b) AS losses FROM ru WHERE doc_id % 2 = 1) SELECT wins, losses, false AS promote FROM x""")
def promotion_window(spark, d):
    """The odd documents as confirmation of what was chosen on the even ones; a case that failed closed stops the promotion."""
    rows = _runs(spark, d).withColumn("case_id", F.col("doc_id"))
    odd = rows.where("doc_id % 2 = 1")
    out = gates.promoted_on_window(odd.select("case_id", F.col("b").alias("joint_correct"), (F.col("doc_id") % 101 == 1).alias("fail_closed")), odd.select("case_id", F.col("a").alias("joint_correct")), rows.where("doc_id % 2 = 0").select("case_id"))
    return out.select("wins", "losses", "promote")


@named(f"WITH {_RUNS}, x AS (SELECT source, count(*) AS n, count(*) FILTER (NOT b) AS k FROM ru GROUP BY source), w AS (SELECT source, k / n AS p, n, 1.6448536269514722::DOUBLE AS z FROM x) SELECT source, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 9) AS upper FROM w")
def wilson_upper_by_source(spark, d):
    """The one-sided upper end of the share of toxic documents of each source."""
    rows = _runs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("b")).alias("k"))
    return rows.select("source", F.round(stats.wilson_upper(F.col("k"), F.col("n")), 9).alias("upper"))


@named(f"WITH {_RUNS} SELECT doc_id, (row_number() OVER (ORDER BY a, sha256('42:' || doc_id)) - 1) % 5 AS fold FROM ru")
def stratified_folds(spark, d):
    """Five folds of the labelled documents, exact strata of their quality."""
    return selectors.stratified_folds(_runs(spark, d).select("doc_id", F.col("a").cast("int").alias("label")), "doc_id").withColumn("fold", F.col("fold").cast("long"))


# judges and life cycles: labels as verdicts of judges, turns as attempts


@named("SELECT 'human=' || CASE quality WHEN 1 THEN 'supported' ELSE 'unsupported' END || '|judge=' || CASE toxic WHEN 0 THEN 'supported' ELSE 'unsupported' END AS cell, count(*) AS n FROM labels GROUP BY cell")
def judge_confusion(spark, d):
    say = lambda c, yes: F.when(F.col(c) == yes, "supported").otherwise("unsupported")
    return judging.confusion(table(spark, d, "labels").select(say("quality", 1).alias("human"), say("toxic", 0).alias("judge")), "human", "judge")


_VOTES = "vo AS (SELECT doc_id, unnest(['f1', 'f2', 'f3']) AS family, unnest([quality, 1 - toxic, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END]) AS yes, CASE WHEN doc_id % 2 = 0 THEN quality ELSE 1 - quality END AS human FROM labels)"


@named(f"WITH {_VOTES}, c AS (SELECT doc_id, any_value(human) AS human, min(yes) AS lo, max(yes) AS hi FROM vo GROUP BY doc_id) SELECT doc_id AS task_id, CASE human WHEN 1 THEN 'supported' ELSE 'unsupported' END AS human, CASE lo WHEN 1 THEN 'supported' ELSE 'unsupported' END AS consensus FROM c WHERE lo = hi AND lo <> human")
def family_consensus(spark, d):
    """Where three families of judges agree with one another, and not with a person."""
    q = F.col("quality")
    say = lambda c: F.when(c == 1, "supported").otherwise("unsupported")
    third = F.when(F.col("doc_id") % 5 == 0, 1 - q).otherwise(q)
    votes = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), say(c).alias("decision")) for f, c in (("f1", q), ("f2", 1 - F.col("toxic")), ("f3", third))])).alias("v")
    rows = table(spark, d, "labels")
    human = rows.select(F.col("doc_id").alias("task_id"), say(F.when(F.col("doc_id") % 2 == 0, q).otherwise(1 - q)).alias("human"))
    return judging.family_consensus(rows.select(F.col("doc_id").alias("task_id"), votes).select("task_id", "v.family", "v.decision"), human)


@named("SELECT doc_id AS task_id, CASE WHEN doc_id % 7 = 0 THEN 'supported' ELSE CASE quality WHEN 1 THEN 'supported' ELSE 'unsupported' END END AS human FROM labels")
def overridden_labels(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("task_id"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("human"))
    return judging.override(rows, rows.where("task_id % 7 = 0").select("task_id", F.col("human").alias("original"), F.lit("supported").alias("adjudicated")))


_ATTEMPTS = "att AS (SELECT 'c' || conv_id AS custom_id, turn AS attempt, (conv_id + turn) % 3 <> 0 AS valid, role AS output FROM conversations WHERE turn > 0)"


def _attempts(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, d, "conversations")
    name = F.concat(F.lit("c"), i.cast("string")).alias("custom_id")
    return rows.select(name).distinct(), rows.where("turn > 0").select(name, t.alias("attempt"), ((i + t) % 3 != 0).alias("valid"), F.col("role").alias("output"))


@named(f"""WITH {_ATTEMPTS}, b AS (SELECT custom_id, max({{'v': valid, 'a': attempt}}) AS m, count(*) AS n FROM att GROUP BY custom_id), i AS (SELECT DISTINCT 'c' || conv_id AS custom_id FROM conversations)
SELECT i.custom_id, m.a AS attempt, coalesce(m.v, false) AS valid, output, coalesce(n, 0) AS attempts FROM i LEFT JOIN b ON b.custom_id = i.custom_id LEFT JOIN att ON att.custom_id = b.custom_id AND att.attempt = m.a""")
def final_attempts(spark, d):
    """Each request's last valid attempt, or its last."""
    return lifecycle.final_attempts(*_attempts(spark, d))


@named(f"WITH {_ATTEMPTS} SELECT DISTINCT 'c' || conv_id AS batch_id FROM conversations WHERE 'c' || conv_id NOT IN (SELECT custom_id FROM (SELECT custom_id, arg_max(valid, attempt) AS v FROM att GROUP BY custom_id) WHERE v)")
def pending_batches(spark, d):
    """What a resumed run has still to do, invalid records done again."""
    asked, tried = _attempts(spark, d)
    history = tried.select(F.col("custom_id").alias("batch_id"), F.col("attempt").alias("sequence"), "valid", F.lit("run").alias("identity"))
    return lifecycle.pending(asked.select(F.col("custom_id").alias("batch_id")), history, "run", retry_invalid=True)


@named("SELECT 'r' || event_id AS custom_id, CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'output' END AS source, props AS body FROM events")
def indexed_results(spark, d):
    """A provider's two files of results as one, ids single."""
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("custom_id"), F.col("props").alias("body"))
    return lifecycle.indexed(rows.where("event_id % 9 <> 0"), rows.where("event_id % 9 = 0")).select("custom_id", "source", "body")


@named("SELECT conv_id, turn, text AS said FROM conversations WHERE role = 'assistant'")
def response_texts(spark, d):
    """Answers wrapped as a provider's response bodies, and their texts taken out again."""
    part = lambda t: F.struct(F.lit("output_text").alias("type"), t.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    content = F.array(part(F.substring(F.col("text"), F.lit(1), half)), part(F.substring(F.col("text"), half + 1, F.length("text"))))
    message = F.struct(F.lit("message").alias("type"), content.alias("content"))
    body = F.to_json(F.struct(F.lit("completed").alias("status"), F.array(F.struct(F.lit("reasoning").alias("type"), F.slice(content, 1, 0).alias("content")), message).alias("output")))
    return table(spark, d, "conversations").where("role = 'assistant' AND length(text) > 0").select("conv_id", "turn", lifecycle.output_text(body).alias("said"))


@named("WITH f AS (SELECT source, 'f' || doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE sha256(text) END AS h FROM documents WHERE lang = 'es') SELECT source, sha256('{' || string_agg('\"' || path || '\":' || CASE WHEN h IS NULL THEN 'null' ELSE '\"' || h || '\"' END, ',' ORDER BY path) || '}') AS fingerprint FROM f GROUP BY source")
def version_fingerprints(spark, d):
    """The Spanish documents of a source as the files of a version; some are not there."""
    files = table(spark, d, "documents").where("lang = 'es'").select("source", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 6 != 0, F.sha2("text", 256)).alias("sha256"))
    return freezes.fingerprint(files, ["source"])


@named("SELECT source AS artifact, 'f' || doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'missing' ELSE 'hash_mismatch' END AS code FROM documents WHERE doc_id % 6 = 0 OR doc_id % 10 = 3")
def artifact_faults(spark, d):
    """Claims on files that are not there or have changed."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("artifact"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    claims = rows.select("artifact", "path", F.when(F.col("doc_id") % 10 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return freezes.hash_faults(rows.where("doc_id % 6 <> 0").select("path", "sha256"), claims)


@named("SELECT doc_id, CASE WHEN quality = 1 THEN 'answer' WHEN toxic = 1 THEN 'abstain_unauthorized' ELSE 'abstain_absent' END AS action FROM labels")
def expected_actions(spark, d):
    rows = table(spark, d, "labels")
    answerability = F.when(F.col("quality") == 1, "answerable").otherwise("unanswerable")
    reason = F.when(F.col("quality") == 1, F.lit(None).cast("string")).when(F.col("toxic") == 1, "abstain_unauthorized").otherwise("abstain_absent")
    return rows.select("doc_id", scoring.expected_action(answerability, reason).alias("action"))


# rechecks and audits: a conversation's turns as rounds; documents as the cases of a run


_ROUNDS = "ro AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn % 3 <> 2 AS valid FROM conversations)"


def _rounds(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), "turn", F.coalesce("text", F.lit("")).alias("prediction"), F.array("role").alias("citation_ids"))
    first = rows.where("turn = 0").select("case_id", "prediction", "citation_ids")
    value = F.struct("prediction", "citation_ids")
    before = F.last(F.when(F.col("turn") % 3 != 2, value), ignorenulls=True).over(Window.partitionBy("case_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    log = rows.withColumn("before", before).where("turn > 0 AND turn % 3 <> 2").select(F.col("turn").cast("int").alias("version"), "case_id", "before", value.alias("after"), F.lit("recheck").alias("reason"))
    return first, log.join(first.select("case_id"), "case_id", "left_semi").select("version", "case_id", "before", "after", "reason")


@named(f"WITH {_ROUNDS}, f AS (SELECT conv_id FROM ro WHERE turn = 0) SELECT conv_id AS case_id, arg_max(text, turn) AS prediction, max(turn)::INT AS version FROM ro JOIN f USING (conv_id) WHERE turn <= 4 AND (valid OR turn = 0) GROUP BY conv_id")
def recheck_replay(spark, d):
    """Results as they were after the fourth round."""
    return rechecks.replayed(*_rounds(spark, d), 4).select("case_id", "prediction", "version")


@named("SELECT 1 AS case_id, 1 AS version WHERE false")
def recheck_log_faults(spark, d):
    """Changes that don't follow from the one before: none, as the log is whole."""
    out = rechecks.log_faults(*_rounds(spark, d))
    return out.select(F.col("case_id").cast("int").alias("case_id"), "version")


_AUDITED = """au AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fever' WHEN 1 THEN 'hotpotqa' ELSE 'natural_questions' END AS benchmark_id, quality = 1 AS joint, quality = 1 OR doc_id % 10 <> 7 AS evidence, doc_id % 17 = 0 AS closed FROM labels)"""


@named(f"""WITH {_AUDITED}
SELECT 'benchmark_known' AS check, 0 AS n UNION ALL SELECT 'zero_fail_closed', count(*) FROM au WHERE closed UNION ALL SELECT 'joint_has_evidence', count(*) FROM au WHERE joint AND NOT evidence
UNION ALL SELECT 'joint_is_answered', count(*) FROM au WHERE joint AND closed UNION ALL SELECT 'precision_is_a_share', 0 UNION ALL SELECT 'recall_is_a_share', 0
UNION ALL SELECT 'ids_unique', 0 UNION ALL SELECT 'counts_exact', 1 UNION ALL SELECT 'metrics_recompute', 1 UNION ALL SELECT 'macro_gate', CASE WHEN (SELECT avg(r) FROM (SELECT avg(joint::INT) AS r FROM au GROUP BY benchmark_id)) >= 0.6 THEN 0 ELSE 1 END""")
def run_audit(spark, d):
    """Labelled documents as the cases of a run, whose report has one metric wrong and whose suite has one case too many."""
    i, good = F.col("doc_id"), F.col("quality") == 1
    metric = lambda m: {"joint_correct": good, "evidence_complete": good | (i % 10 != 7)}.get(m, F.lit(1.0) if m in ("citation_precision", "citation_recall", "answer_exact_match", "answer_f1") else F.lit(True))
    name = F.when(i % 3 == 0, "fever").when(i % 3 == 1, "hotpotqa").otherwise("natural_questions")
    rows = table(spark, d, "labels").select(i.alias("case_id"), name.alias("benchmark_id"), (i % 17 == 0).alias("fail_closed"), *[metric(m).alias(m) for m in scoring.CASE_METRICS])
    report = audits.by_metric(scoring.aggregate(rows))
    wrong = (F.col("benchmark_id") == "fever") & (F.col("metric") == "case_count")
    targets = rows.groupBy("benchmark_id").agg((F.count("*") + F.max((F.col("benchmark_id") == "hotpotqa").cast("int"))).alias("target"))
    return audits.run_audit(rows, report.withColumn("value", F.when(wrong, -1.0).otherwise(F.col("value"))), targets).select("check", "n")
