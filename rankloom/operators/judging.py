"""Judges: verdicts on claims and their validation, agreement with people, cascades of judges and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import anchors, stats
from ..functions.text import loses_negation
from . import metrics
from .contracts import Rules, broken, field, given, has_text, is_kind, items, json_value, keys, string


#: The contract's version, statuses and fields of both lanes, task types with the verdicts that accept and that a failure falls back to.
VERSION = "1.0.0"
SUPPORT_STATUSES = ("supported", "contradicted", "unsupported")
COVERAGE_STATUSES = ("covered", "contradicted", "missing")
SUPPORT_FIELDS = ("generated_claim_id", "status", "evidence", "rationale")
COVERAGE_FIELDS = ("required_claim_id", "status", "generated_claim_ids", "rationale")
SUPPORT_TASK = "generated_claim_support"
ACCEPTS, FALLBACKS = ("supported", "covered"), ("unsupported", "missing")
SEVERE = ("high", "critical")
#: What a judge must reach in a bake-off.
MOST_FALSE_ACCEPTS, LEAST_AGREEMENT, LEAST_KAPPA = 0.02, 0.90, 0.80

#: What a verdict gets of a lane: the fields and statuses of its own, and which status accepts.
_SUPPORT = ("claim_verdicts", "generated_claim_id", "g", SUPPORT_FIELDS, SUPPORT_STATUSES, ACCEPTS[0])
_COVERAGE = ("required_claim_verdicts", "required_claim_id", "r", COVERAGE_FIELDS, COVERAGE_STATUSES, ACCEPTS[1])


def _same(found: Column, wanted: tuple[str, ...]) -> Column:
    return (F.size(found) == len(wanted)) & F.forall(found, lambda k: k.isin(*wanted))


def _codes(rules: Rules, of: Column) -> Column:
    return F.transform(broken(rules, of), lambda e: e["code"])


def _forms(fields: tuple[str, ...], statuses: tuple[str, ...]) -> Rules:
    """What a verdict of either lane must be."""
    return [
        ("verdict_type", "", lambda v: ~v["object"]),
        ("verdict_fields", "", lambda v: v["object"] & ~_same(v["keys"], fields)),
        ("status", "", lambda v: v["object"] & ~F.coalesce(v["status"].isin(*statuses), F.lit(False))),
        ("rationale", "", lambda v: v["object"] & ~has_text(v["rationale"])),
    ]


SUPPORT_RULES: Rules = [
    ("evidence_type", "", lambda v: v["object"] & ~is_kind(v["links"], "ARRAY")),
    ("evidence_required", "", lambda v: v["status"].isin("supported", "contradicted") & (F.size(v["evidence"]) == 0)),
    ("unsupported_with_evidence", "", lambda v: (v["status"] == "unsupported") & (F.size(v["evidence"]) > 0)),
]
EVIDENCE_RULES: Rules = [
    ("evidence_fields", "", lambda e: ~e["formed"]),
    ("duplicate_evidence", "", lambda e: e["formed"] & F.array_contains(e["earlier"], e["key"])),
    ("uncited_evidence", "", lambda e: e["formed"] & ~e["cited"]),
    ("empty_quote", "", lambda e: e["formed"] & e["cited"] & ~e["quote"].rlike(r"(?U)\S")),
    ("quote_not_found", "", lambda e: e["formed"] & e["cited"] & e["quote"].rlike(r"(?U)\S") & ~F.contains(e["source"], e["quote"])),
]
COVERAGE_RULES: Rules = [
    ("generated_claim_ids_type", "", lambda v: v["object"] & ~is_kind(v["links"], "ARRAY")),
    ("duplicate_generated_claim_id", "", lambda v: F.size(F.array_distinct(v["names"])) < F.size(v["names"])),
    ("unknown_generated_claim_id", "", lambda v: F.size(v["strange"]) > 0),
    ("missing_with_links", "", lambda v: (v["status"] == "missing") & (F.size(v["names"]) > 0)),
    ("verdict_without_links", "", lambda v: v["status"].isin("covered", "contradicted") & (F.size(v["names"]) == 0)),
]


def _lost(reference: Column, candidate: Column, prefix: str = "") -> Column:
    """What a candidate must keep of a reference and doesn't."""
    anchor = F.when(F.size(anchors.missing_anchors(reference, candidate)) > 0, F.lit(f"{prefix}exact_anchor_missing"))
    return F.array_compact(F.array(anchor, F.when(loses_negation(reference, candidate), F.lit(f"{prefix}explicit_negation_missing"))))


def _judged(judgment: Column, count: Column, lane: tuple, own: Callable[[Column, Column], Column]) -> Column:
    """The verdict on a judgment: codes of its outer form, of each verdict (those of `own` with them) and of the verdicts' order."""
    field_name, id_name, letter, fields, statuses, accepts = lane

    def verdicts(v: Column) -> Column:
        return F.transform(items(field(v, field_name)), lambda x: F.struct(
            is_kind(x, "OBJECT").alias("object"), keys(x).alias("keys"), string(field(x, "status")).alias("status"), field(x, "rationale").alias("rationale"),
            field(x, fields[2]).alias("links"), items(field(x, fields[2])).alias("evidence"), string(field(x, id_name)).alias("id"),
        ))

    def verdict(v: Column) -> Column:
        outer = F.array_compact(F.array(
            F.when(~_same(keys(v), ("schema_version", field_name)), F.lit("fields")), F.when(~string(field(v, "schema_version")).eqNullSafe(VERSION), F.lit("schema_version")),
            F.when(~is_kind(field(v, field_name), "ARRAY"), F.lit("verdicts_type")),
        ))

        def of(all_: Column) -> Column:
            each = F.flatten(F.transform(all_, lambda x, i: F.concat(_codes(_forms(fields, statuses), x), own(x, i))))
            wanted = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit(letter), i.cast("string")))).otherwise(F.array().cast("array<string>"))
            found = F.transform(F.filter(all_, lambda x: x["object"]), lambda x: x["id"])
            order = F.when(found.eqNullSafe(wanted), F.array().cast("array<string>")).otherwise(F.array(F.lit("id_order")))
            codes = F.when(is_kind(v, "OBJECT"), F.concat(outer, each, order)).otherwise(F.array(F.lit("root_type")))
            good = F.size(F.filter(all_, lambda x: x["status"] == accepts))
            return given(codes, lambda c: given(F.when(F.size(c) == 0, good).otherwise(0).cast("long"), lambda n: F.struct(
                (F.size(c) == 0).alias("valid"), c.alias("codes"), count.cast("long").alias("claims"), n.alias("accepted"), F.when(count > 0, n / count).otherwise(0.0).alias("rate"), ((count > 0) & (n == count)).alias("passes"),
            )))

        return given(verdicts(v), of)

    return given(json_value(judgment), verdict)


def support(judgment: Column, claims: Column, sources: Column) -> Column:
    """The verdict on a judgment (JSON) that claims are supported; claims and sources: JSON arrays of text and citation_ids, of citation_id and text."""
    said = F.coalesce(F.from_json(claims, "array<struct<text:string,citation_ids:array<string>>>"), F.from_json(F.lit("[]"), "array<struct<text:string,citation_ids:array<string>>>"))
    texts = F.from_json(sources, "array<struct<citation_id:string,text:string>>")
    text_of = lambda name: F.coalesce(F.get(F.filter(texts, lambda s: s["citation_id"] == name), F.lit(0))["text"], F.lit(""))

    def own(v: Column, i: Column) -> Column:
        cited = F.coalesce(F.get(said, i)["citation_ids"], F.array().cast("array<string>"))

        def piece(e: Column) -> Column:
            source, quote = string(field(e, "citation_id")), F.coalesce(string(field(e, "quote")), F.lit(""))
            return F.struct(
                (is_kind(e, "OBJECT") & _same(keys(e), ("citation_id", "quote"))).alias("formed"), F.to_json(e).alias("key"), F.coalesce(F.array_contains(cited, source), F.lit(False)).alias("cited"),
                quote.alias("quote"), text_of(source).alias("source"),
            )

        def evidence(pieces: Column) -> Column:
            names = ("formed", "key", "cited", "quote", "source")
            earlier = lambda k: F.slice(F.transform(pieces, lambda p: p["key"]), F.lit(1), k)
            return F.flatten(F.transform(pieces, lambda p, k: _codes(EVIDENCE_RULES, F.struct(*[p[n].alias(n) for n in names], earlier(k).alias("earlier")))))

        claim = F.get(said, i)
        lost = _lost(claim["text"], F.array_join(F.transform(cited, text_of), "\n"))
        kept = F.when((v["status"] == "supported") & claim.isNotNull(), lost).otherwise(F.array().cast("array<string>"))
        return F.concat(_codes(SUPPORT_RULES, v), given(F.transform(v["evidence"], piece), evidence), F.coalesce(kept, F.array().cast("array<string>")))

    return _judged(judgment, F.size(said), _SUPPORT, own)


def coverage(judgment: Column, required: Column, claims: Column) -> Column:
    """The verdict on a judgment (JSON) that an answer's claims cover the required ones (arrays of texts)."""

    def own(v: Column, i: Column) -> Column:
        names = F.transform(v["evidence"], lambda x: F.coalesce(string(x), F.to_json(x)))
        place = lambda n: F.when(n.rlike(r"^g[1-9]\d{0,8}$"), F.substring(n, 2, 9).cast("int"))
        strange = F.filter(names, lambda n: ~F.coalesce(place(n) <= F.size(claims), F.lit(False)))
        parsed = F.struct(*[v[c].alias(c) for c in ("object", "status", "links")], names.alias("names"), strange.alias("strange"))

        def of(x: Column) -> Column:
            said = F.array_join(F.transform(x["names"], lambda n: F.get(claims, place(n) - 1)), " ")
            needed = F.get(required, i)
            kept = F.when((x["status"] == "covered") & (F.size(x["strange"]) == 0) & needed.isNotNull(), _lost(needed, said, "coverage_"))
            return F.concat(_codes(COVERAGE_RULES, x), F.coalesce(kept, F.array().cast("array<string>")))

        return given(parsed, of)

    return _judged(judgment, F.size(required), _COVERAGE, own)


def claim_level_pass(valid: Column, supported: Column, covered: Column) -> Column:
    """Both lanes are valid and accept every claim."""
    return F.coalesce(valid & supported["passes"] & covered["passes"], F.lit(False))


def accept_of(task_type: Column) -> Column:
    return F.when(task_type == SUPPORT_TASK, ACCEPTS[0]).otherwise(ACCEPTS[1])


def fallback_of(task_type: Column) -> Column:
    return F.when(task_type == SUPPORT_TASK, FALLBACKS[0]).otherwise(FALLBACKS[1])


def kappa_of(pairs: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """([by,] n, exact_agreement, cohen_kappa) of two raters' labels, from the table of their pairs. A chance agreement of 1 gives 1 or 0."""
    by = by or []
    cell = pairs.groupBy(*by, F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count("*").alias("c"))
    n = cell.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("l") == F.col("r"), F.col("c")).otherwise(0)).alias("same"))
    side = lambda c: cell.groupBy(*by, F.col(c).alias("label")).agg(F.sum("c").alias(f"{c}_n"))
    chance = side("l").join(side("r"), [*by, "label"]).groupBy(*by).agg(F.sum(F.col("l_n") * F.col("r_n")).alias("both"))
    rows = n.join(chance, by, "left") if by else n.crossJoin(F.broadcast(chance))  # one row
    seen, luck = stats.rate(F.col("same"), F.col("n")), stats.rate(F.coalesce("both", F.lit(0)), F.col("n") * F.col("n"))
    return rows.select(*by, "n", seen.alias("exact_agreement"), F.when(luck == 1.0, (seen == 1.0).cast("double")).otherwise(F.try_divide(seen - luck, 1 - luck)).alias("cohen_kappa"))


def agreement(human: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary by lane, disagreements, unmatched cases) of people's labels (case_id, lane, claim_id, status, answer_sha256) and a judge's (case_id, lane, claim_id, status, answer_sha256).

    A case counts only if the judge saw the same answer; a claim without a verdict is a disagreement and no pair.
    """
    seen = judged.select("case_id", F.col("answer_sha256").alias("theirs")).distinct()
    cases = human.select("case_id", "answer_sha256").distinct().join(seen, "case_id", "left")
    problem = F.when(F.col("theirs").isNull(), "missing_judgment").when(F.col("theirs") != F.col("answer_sha256"), "answer_hash_mismatch")
    cases = cases.withColumn("problem", problem)
    unmatched = cases.where("problem IS NOT NULL").select("case_id", "problem")
    rows = human.join(cases.where("problem IS NULL").select("case_id"), "case_id", "left_semi").select("case_id", "lane", "claim_id", F.col("status").alias("human"))
    rows = rows.join(judged.select("case_id", "lane", "claim_id", F.col("status").alias("judge")), ["case_id", "lane", "claim_id"], "left")
    kind = F.when(F.col("judge").isNull(), "missing_judge_verdict").when(F.col("judge") != F.col("human"), "label_disagreement")
    rows = rows.withColumn("kind", kind)
    pairs = rows.where("judge IS NOT NULL")
    accepted = F.col("judge").isin(*ACCEPTS) & (F.col("judge") != F.col("human"))
    false = pairs.groupBy("lane").agg(F.count_if(accepted).alias("false_accept_count"))
    summary = kappa_of(pairs, "human", "judge", ["lane"]).join(false, "lane").withColumn("false_accept_rate", stats.rate(F.col("false_accept_count"), F.col("n")))
    return summary, rows.where("kind IS NOT NULL").select("case_id", "lane", "claim_id", "human", "judge", "kind"), unmatched


def confusion(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.groupBy(F.concat(F.lit("human="), left, F.lit("|judge="), right).alias("cell")).agg(F.count("*").alias("n"))


def task_verdicts(records: DataFrame) -> DataFrame:
    """(profile, group_id, task_id, decision) of records (profile, group_id, valid, verdicts: array of task_id and decision): those of valid groups."""
    return records.where("valid").select("profile", "group_id", F.explode("verdicts").alias("v")).select("profile", "group_id", "v.task_id", "v.decision")


def invalid_groups(records: DataFrame) -> DataFrame:
    return records.where(~F.coalesce("valid", F.lit(False))).select("profile", "group_id")


def task_groups(tasks: DataFrame, order: str) -> DataFrame:
    """The tasks with `group_no`: groups of case and type, numbered as they first come."""
    first = tasks.groupBy("case_id", "task_type").agg(F.min(order).alias("__first"))
    places = metrics.numbered(first, F.col("__first"), "__place").withColumn("group_no", (F.col("__place") + 1).cast("int"))
    return tasks.join(places.drop("__first", "__place"), ["case_id", "task_type"])


def resolve(task_type: Column, first: Column, second: Column, adjudicator: Column, maximum: Column | None = None) -> tuple[Column, Column]:
    """(decision, fail_closed) of a task's verdicts: two that agree stand; else the adjudicator's, or the last resort's, which may accept only with one of the two."""
    candidate = F.coalesce(adjudicator, F.lit(None).cast("string") if maximum is None else maximum)
    agree = F.coalesce(first == second, F.lit(False))
    lonely = (candidate == accept_of(task_type)) & ~F.coalesce(first == candidate, F.lit(False)) & ~F.coalesce(second == candidate, F.lit(False))
    closed = ~agree & (candidate.isNull() | F.coalesce(lonely, F.lit(False)))
    return F.when(agree, first).when(closed, fallback_of(task_type)).otherwise(candidate), closed


def simulate(tasks: DataFrame, records: DataFrame, mode: str, primary: str, secondary: str | None = None, adjudicator: str | None = None, maximum: str | None = None, routine_rate: float = 0.0) -> DataFrame:
    """(group_id, task_id, case_id, task_type, lane, severity, decision, fail_closed, consulted) of a cascade over recorded judges.

    Modes: `single` asks the primary only; `full_panel` all; `disagreement` always a second, `primary_failure` one where the primary does not accept every task of the group,
    `severity_sample` one for severe groups, a hash sample of the others and where the primary gave nothing. A second that does not agree brings the adjudicator, and one without a valid record the last resort.
    """
    names = {"p": primary, "s": secondary, "a": adjudicator, "m": maximum}
    v = task_verdicts(records).groupBy("group_id", "task_id").agg(*[F.max(F.when(F.col("profile") == n, F.col("decision"))).alias(k) for k, n in names.items()])
    gave = records.where("valid").groupBy("group_id").agg(*[F.bool_or((F.col("profile") == n) & (F.size("verdicts") > 0)).alias(f"has_{k}") for k, n in names.items()])
    rows = tasks.join(v, ["group_id", "task_id"], "left").join(gave, "group_id", "left").fillna(False, [f"has_{k}" for k in names])
    w = Window.partitionBy("group_id")
    p, s, a, m, kind = F.col("p"), F.col("s"), F.col("a"), F.col("m"), F.col("task_type")
    none = F.lit(None).cast("string")
    any_ = lambda c: F.max(c.cast("int")).over(w) == 1
    has = lambda k: F.coalesce(f"has_{k}", F.lit(False))
    if mode == "single":
        second = third = last = F.lit(False)
    elif mode == "full_panel":
        second = third = last = F.lit(True)
    else:
        rate = F.conv(F.substring(F.sha2(F.col("group_id").cast("string"), 256), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF) < routine_rate
        asks = {"disagreement": F.lit(True), "primary_failure": ~has("p") | any_(~F.coalesce(p == accept_of(kind), F.lit(False))), "severity_sample": any_(F.col("severity").isin(*SEVERE)) | rate | ~has("p")}
        if mode not in asks:
            raise ValueError(f"no mode {mode}")
        second = asks[mode]
        third = second & (~has("p") | ~has("s") | any_(~p.eqNullSafe(s)))
        last = third & ~has("a")
    rows = rows.withColumns({"__2": second, "__3": third, "__4": last})
    decided, closed = resolve(kind, p, F.when(F.col("__2"), s).otherwise(none), F.when(F.col("__3"), a).otherwise(none), F.when(F.col("__4"), m).otherwise(none))
    alone = ~F.col("__2")
    asked = F.array_compact(F.array(F.lit(primary), F.when(F.col("__2"), F.lit(secondary)), F.when(F.col("__3"), F.lit(adjudicator)), F.when(F.col("__4"), F.lit(maximum))))
    known = records.select("profile").distinct().agg(F.collect_set("profile").alias("__known"))
    rows = rows.crossJoin(F.broadcast(known))  # one row, a name a judge
    return rows.select(
        "group_id", "task_id", "case_id", "task_type", "lane", "severity", F.when(alone, F.coalesce(p, fallback_of(kind))).otherwise(decided).alias("decision"),
        F.when(alone, p.isNull()).otherwise(closed).alias("fail_closed"), F.filter(asked, lambda x: F.array_contains("__known", x)).alias("consulted"),
    )


def cascade_operation(predictions: DataFrame, calls: DataFrame) -> DataFrame:
    """(calls, cost, mean_latency) of a cascade and calls (profile, group_id, cost, latency_ms): each judge is asked once a group, one after another."""
    asked = predictions.select("group_id", F.explode("consulted").alias("profile")).distinct().join(calls.groupBy("profile", "group_id").agg(F.sum("cost").alias("cost"), F.sum("latency_ms").alias("ms")), ["profile", "group_id"], "left")
    group = asked.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("ms"))
    return group.agg(F.sum("n").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.avg("ms").alias("mean_latency"))


def score(predictions: DataFrame, human: DataFrame, sets: list[str] | None = None) -> DataFrame:
    """Agreement, kappa, false accepts and rejects of predictions (task_id, task_type, decision, fail_closed, severity, ...) against people (task_id, human); over all and, for
    each column of `sets`, by it (`slice`: column=value)."""
    rows = predictions.join(human.select("task_id", "human"), "task_id")
    slices = F.array(F.lit("all"), *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sets or []])
    rows = rows.withColumn("slice", F.explode(slices))
    yes = accept_of(F.col("task_type"))
    wrong_yes, wrong_no = (F.col("decision") == yes) & (F.col("human") != yes), (F.col("human") == yes) & (F.col("decision") != yes)
    counts = rows.groupBy("slice").agg(
        F.count_if(wrong_yes).alias("false_accept_count"), F.count_if(wrong_yes & F.col("severity").isin(*SEVERE)).alias("severe_false_accept_count"),
        F.count_if(wrong_no).alias("false_reject_count"), F.count_if("fail_closed").alias("fail_closed_count"), F.count_if(F.col("human") != F.col("decision")).alias("disagreement_count"),
    )
    out = kappa_of(rows, "human", "decision", ["slice"]).withColumnRenamed("n", "task_count").join(counts, "slice")
    n = F.col("task_count")
    return out.withColumns({"false_accept_rate": stats.rate(F.col("false_accept_count"), n), "false_accept_upper": stats.wilson_upper(F.col("false_accept_count"), n), "false_reject_rate": stats.rate(F.col("false_reject_count"), n)})


def bakeoff(records: DataFrame, human: DataFrame) -> DataFrame:
    """A row a judge of records (profile, group_id, valid, tasks, verdicts, calls, retry_history): validity at the first try and in the end, agreement with people (task_id, human), false
    accepts and rejects, calls, latency, cost and usage, and whether it reaches each target.

    tasks: array of (task_id, case_id, task_type, lane, severity); verdicts: of (task_id, decision), the last of a task counts; calls: of (latency_ms, cost, usage: a map); retry_history: of
    (valid, calls), the first try first, empty or null where there was one try. Costs that no call reports are null, not 0. A judged task that no person has judged is an error.
    """
    tries = F.coalesce(F.size(F.filter("retry_history", lambda x: x.isNotNull())), F.lit(0))
    tries = F.when(tries > 0, tries).otherwise(0)
    first = F.when(tries > 0, F.get("retry_history", F.lit(0))["valid"]).otherwise(F.col("valid"))
    now, before = (F.when(c.isNotNull(), c) for c in (F.col("calls"), F.flatten(F.col("retry_history")["calls"])))
    costs = lambda c: F.filter(c["cost"], lambda x: x.isNotNull())
    total = lambda c: F.when(F.size(costs(c)) > 0, F.aggregate(costs(c), F.lit(0.0), lambda a, x: a + x))
    count = lambda c: F.when(c.isNotNull(), F.size(c)).otherwise(0)
    group = records.groupBy("profile").agg(
        F.sum(F.when(F.coalesce(first, F.lit(False)), F.size("tasks")).otherwise(0)).alias("first_pass_valid_task_count"), F.count_if(tries > 0).alias("retried_group_count"),
        F.sum(count(now)).alias("call_count"), F.sum(total(now)).alias("reported_cost"), F.sum(count(now) + count(before)).alias("call_count_with_retries"),
        F.sum(F.when(total(now).isNotNull() | total(before).isNotNull(), F.coalesce(total(now), F.lit(0.0)) + F.coalesce(total(before), F.lit(0.0)))).alias("reported_cost_with_retries"),
    )
    rows = records.select("profile", "valid", "verdicts", F.explode("tasks").alias("t")).select("profile", "valid", "t.task_id", "t.task_type", "t.severity", F.try_element_at(F.filter("verdicts", lambda v: v["task_id"] == F.col("t.task_id")), F.lit(-1))["decision"].alias("decision"))
    rows = rows.withColumn("valid", F.coalesce(F.col("valid") & F.col("decision").isNotNull(), F.lit(False))).join(human.select("task_id", "human"), "task_id", "left")
    rows = rows.where(F.when(~F.col("valid") | F.col("human").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a judged task that no person has judged"))))
    yes, pair = accept_of(F.col("task_type")), F.col("valid")
    wrong_yes, wrong_no = pair & (F.col("decision") == yes) & (F.col("human") != yes), pair & (F.col("human") == yes) & (F.col("decision") != yes)
    tasks = rows.groupBy("profile").agg(
        F.count("*").alias("task_count"), F.count_if(pair).alias("valid_task_count"), F.count_if(wrong_yes).alias("false_accept_count"), F.count_if(wrong_no).alias("false_reject_count"),
        F.count_if(wrong_yes & F.col("severity").isin(*SEVERE)).alias("severe_false_accept_count"), F.count_if(pair & (F.col("human") != F.col("decision"))).alias("disagreement_count"),
    )
    agreed = kappa_of(rows.where("valid"), "human", "decision", ["profile"]).drop("n")
    calls = records.select("profile", F.explode("calls").alias("c")).select("profile", F.col("c.latency_ms").cast("double").alias("ms"), "c.usage")
    marks = metrics.nearest_rank_percentiles(calls, "ms", (0.5, 0.95, 0.99), ["profile"])
    marks = marks.groupBy("profile").agg(*[F.max(F.when(F.col("fraction") == f, F.col("value"))).alias(f"latency_p{f * 100:.0f}") for f in (0.5, 0.95, 0.99)])
    used = calls.select("profile", F.explode("usage").alias("k", "u")).groupBy("profile", "k").agg(F.sum("u").alias("u"))
    used = used.groupBy("profile").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "u")))).alias("usage_totals"))
    out = group.join(tasks, "profile", "left")
    for part in (agreed, calls.groupBy("profile").agg(F.avg("ms").alias("latency_mean")), marks, used):
        out = out.join(part, "profile", "left")
    n, good = F.coalesce("task_count", F.lit(0)), F.coalesce("valid_task_count", F.lit(0))
    out = out.withColumns({"task_count": n, "valid_task_count": good} | {c: F.coalesce(c, F.lit(0)) for c in ("false_accept_count", "false_reject_count", "severe_false_accept_count", "disagreement_count")})
    out = out.withColumns({
        "validity_rate": stats.rate(good, n), "first_pass_validity_rate": stats.rate(F.col("first_pass_valid_task_count"), n),
        "false_accept_rate": stats.rate(F.col("false_accept_count"), good), "false_reject_rate": stats.rate(F.col("false_reject_count"), good),
    })
    reached = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({
        "all_valid": n == good, "no_severe_false_accept": F.col("severe_false_accept_count") == 0, "few_false_accepts": reached(F.col("false_accept_rate") <= MOST_FALSE_ACCEPTS),
        "enough_agreement": reached(F.col("exact_agreement") >= LEAST_AGREEMENT), "enough_kappa": reached(F.col("cohen_kappa") >= LEAST_KAPPA),
    })


def expand(tasks: DataFrame, records: DataFrame, profile: str) -> DataFrame:
    """(task_id, decision, fail_closed) of one judge: each task of a group without a valid record fails closed."""
    v = task_verdicts(records.where(F.col("profile") == profile)).select("group_id", "task_id", "decision")
    rows = tasks.select("group_id", "task_id", "task_type").join(v, ["group_id", "task_id"], "left")
    return rows.select("task_id", F.coalesce("decision", fallback_of(F.col("task_type"))).alias("decision"), F.col("decision").isNull().alias("fail_closed"))


def family_consensus(votes: DataFrame, human: DataFrame, families: int = 3) -> DataFrame:
    """(task_id, human, consensus) where `families` families of judges (task_id, family, decision) each speak with one voice, all the same, and not a person's."""
    one = votes.groupBy("task_id", "family").agg(F.min("decision").alias("a"), F.max("decision").alias("b"))
    task = one.groupBy("task_id").agg(F.count("*").alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("same"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    rows = task.where((F.col("n") >= families) & F.col("same") & (F.col("lo") == F.col("hi"))).join(human.select("task_id", "human"), "task_id")
    return rows.where(F.col("human") != F.col("lo")).select("task_id", "human", F.col("lo").alias("consensus"))


def override(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """(task_id, human) with the overrides (task_id, original, adjudicated) put in place; one whose original is not the label any more, or has no task, is an error."""
    both = labels.select("task_id", "human").join(overrides.select("task_id", "original", "adjudicated"), "task_id", "full_outer")
    fine = F.col("human").isNotNull() & (F.col("original").isNull() | (F.col("original") == F.col("human")))
    both = both.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("an override's original has drifted"))))
    return both.select("task_id", F.coalesce("adjudicated", "human").alias("human"))


def provider_parity(records: DataFrame, left: str, right: str, human: DataFrame, least: float = 0.95) -> DataFrame:
    """(agreement, new_false_accepts, validity_fell, passes): two providers of one judge over the same groups: enough agreement, no accept that a person would not give, no less validity."""
    groups = records.where(F.col("profile").isin(left, right)).groupBy("group_id").agg(F.max(F.when(F.col("profile") == left, F.col("valid"))).alias("l"), F.max(F.when(F.col("profile") == right, F.col("valid"))).alias("r"))
    groups = groups.where(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("the providers' groups differ"))))
    valid = groups.agg(F.count_if("l").alias("lv"), F.count_if("r").alias("rv"))
    v = task_verdicts(records).groupBy("task_id").agg(F.max(F.when(F.col("profile") == left, F.col("decision"))).alias("l"), F.max(F.when(F.col("profile") == right, F.col("decision"))).alias("r")).join(human.select("task_id", "human"), "task_id")
    counts = v.agg(F.avg(F.col("l").eqNullSafe(F.col("r")).cast("double")).alias("agreement"), F.count_if(F.col("r").isin(*ACCEPTS) & (F.col("human") != F.col("r")) & ~F.col("l").eqNullSafe(F.col("r"))).alias("new_false_accepts"))
    rows = counts.crossJoin(F.broadcast(valid)).withColumn("validity_fell", F.col("rv") < F.col("lv"))  # one row each
    return rows.select("agreement", "new_false_accepts", "validity_fell", ((F.col("agreement") >= least) & (F.col("new_false_accepts") == 0) & ~F.col("validity_fell")).alias("passes"))
