"""URL filtering by rules and, where no rule fits, by a path-template tree.

For each host the tree goes down the path, a segment a level, as far as a node has `support` pages whose paths go on; further segments can only be wildcards. Under a node a segment that makes up at least `share` of the node's
pages, and `support` of them, is a branch by name; all other segments are one wildcard `*`. Branches by name whose labelled shares of good pages do not differ
from their siblings' together (a two-sided test at 5 %) are merged to `~`. A template's purity is its share of
good labelled pages, smoothed towards its host's, which is smoothed towards that of all; templates under `purity` are rejected.

Counting is by (host, node, segment), summed before the shuffle; a node has at most 1 / share branches by name, so what is joined back is small.

Defined cases: without `://` or with a null url host and path are empty and such pages form a host of their own. Pages without labels count for the tree and
not for purity; if several label rows fit a page their mean counts. Without any labels the purity is 1. Repeated rows are judged each. Ties have no part: counts decide. Very long urls are judged whole; an empty table has an empty result. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Stage, pick

#: The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMOOTH = 4.0


def after_scheme(url: Column) -> Column:
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", support: int = 5, share: float = 0.05, purity: float = 0.6, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """id, host, path, rule, verdict, template, purity."""
    stage = Stage(pages.sparkSession, "urls")
    url = pick(pages, url_col)
    good = labels.select(pick(labels, label_id).alias("__l"), pick(labels, label_col).cast("double").alias("good")).where("__l is not null and good is not null").groupBy("__l").agg(F.avg("good").alias("good"))
    rows = pages.select(pick(pages, id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.join(good, F.col("id") == F.col("__l"), "left").drop("__l")
    rows = rows.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("node", F.lit(""))
    rows = stage.write("level-0", rows)
    level = 0
    while not rows.where(F.size("segments") > level).groupBy("host", "node").count().where(F.col("count") >= support).isEmpty():
        level += 1
        rows = stage.write(f"level-{level}", _descend(rows, level, support, share))
        stage.drop(f"level-{level - 1}")
    rows = rows.withColumn("node", F.concat("node", F.repeat(F.lit("/*"), F.greatest(F.size("segments") - level, F.lit(0)))))
    # purity from the sums of templates, hosts and all
    sums = rows.groupBy("host", "node").agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"), F.count("good").alias("m"))
    hosts = sums.groupBy(F.col("host").alias("h")).agg(F.sum("g").alias("hg"), F.sum("m").alias("hm"))
    whole = hosts.agg((F.coalesce(F.sum("hg"), F.lit(0.0)) / F.nullif(F.sum("hm"), F.lit(0)).cast("double")).alias("all"))
    hosts = hosts.crossJoin(F.broadcast(whole)).select("h", ((F.col("hg") + SMOOTH * F.coalesce("all", F.lit(1.0))) / (F.col("hm") + SMOOTH)).alias("hp"))  # one row to each
    tree = sums.join(hosts, F.col("host") == F.col("h")).select(F.struct("host", "node").alias("key"), ((F.col("g") + SMOOTH * F.col("hp")) / (F.col("m") + SMOOTH)).alias("purity"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(tree, F.struct("host", "node") == F.col("key"))
    return out.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") < purity, "block").otherwise("allow")).alias("verdict"),
        F.concat("host", "node").alias("template"), F.round("purity", 6).alias("purity"),
    )


def _descend(rows: DataFrame, level: int, support: int, share: float) -> DataFrame:
    """Each row's node one level further down, where its path goes on."""
    here = rows.select("host", "node", F.get("segments", F.lit(level - 1)).alias("seg"), "good")
    counts = here.where("seg is not null").groupBy("host", "node", "seg").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"), F.count("good").alias("m"))
    totals = counts.groupBy(F.col("host").alias("h"), F.col("node").alias("o")).agg(F.sum("n").alias("total"))
    named = counts.where(F.col("n") >= support).join(totals, (F.col("host") == F.col("h")) & (F.col("node") == F.col("o"))).where(F.col("n") >= F.col("total") * share).drop("h", "o")
    pooled = named.groupBy(F.col("host").alias("h"), F.col("node").alias("o")).agg(F.sum("g").alias("pg"), F.sum("m").alias("pm"), F.count("*").alias("branches"))
    named = named.join(pooled, (F.col("host") == F.col("h")) & (F.col("node") == F.col("o")))
    own, all_of = F.try_divide("g", "m"), F.try_divide("pg", "pm")
    apart = (F.col("m") > 0) & (F.pow(own - all_of, F.lit(2.0)) * F.col("m") > 3.8416 * all_of * (1 - all_of))
    sign = F.when((F.col("branches") == 1) | F.coalesce(apart, F.lit(False)), F.col("seg")).otherwise("~")
    named = named.select(F.struct("host", "node", "seg").alias("key"), sign.alias("sign"))
    seg = F.get("segments", F.lit(level - 1))
    out = rows.withColumn("seg", seg).join(named, F.struct("host", "node", "seg") == F.col("key"), "left")
    return out.withColumn("node", F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("sign", F.lit("*"))))).drop("seg", "key", "sign")


def _sql(depth: int = 12) -> str:
    """SQL for paths of at most `depth` segments."""
    rule = "CASE " + " ".join(f"WHEN (l.host = '{d}' OR ends_with(l.host, '.{d}')) AND starts_with(path, '/{r}') THEN '{{{i}}}'" for i, (d, _, r) in enumerate(n.partition("/") for n, _ in _by_length())) + " END"
    names, says = rule, rule
    for i, (n, v) in enumerate(_by_length()):
        names, says = names.replace(f"{{{i}}}", n), says.replace(f"{{{i}}}", v)
    parts = [
        f"""u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS s FROM pages),
lab AS (SELECT doc_id, avg(quality::DOUBLE) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
l0 AS (SELECT page_id, translate(regexp_extract(s, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path, good,
         list_filter(string_split(regexp_extract(s, '^[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segments, '' AS node
       FROM u LEFT JOIN lab ON page_id = doc_id)"""
    ]
    for k in range(1, depth + 1):
        parts.append(f"""c{k} AS (SELECT host, node, segments[{k}] AS seg, count(*) AS n, coalesce(sum(good), 0) AS g, count(good) AS m FROM l{k - 1} WHERE segments[{k}] IS NOT NULL GROUP BY ALL),
n{k} AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, node) AS total FROM c{k}) WHERE n >= 5 AND n >= total * 0.05::DOUBLE),
s{k} AS (SELECT *, sum(g) OVER w AS pg, sum(m) OVER w AS pm, count(*) OVER w AS branches FROM n{k} WINDOW w AS (PARTITION BY host, node)),
b{k} AS (SELECT host, node, seg, CASE WHEN branches = 1 OR coalesce(m > 0 AND pow(g / m - pg / pm, 2) * m > 3.8416::DOUBLE * (pg / pm) * (1 - pg / pm), false) THEN seg ELSE '~' END AS sign FROM s{k}),
l{k} AS (SELECT page_id, l.host, path, good, segments, CASE WHEN segments[{k}] IS NULL THEN l.node ELSE l.node || '/' || coalesce(sign, '*') END AS node
         FROM l{k - 1} l LEFT JOIN b{k} b ON l.host = b.host AND l.node = b.node AND segments[{k}] = b.seg)""")
    parts.append(f"""t AS (SELECT host, node, coalesce(sum(good), 0) AS g, count(good) AS m FROM l{depth} GROUP BY ALL),
h AS (SELECT host, (sum(g) + 4.0::DOUBLE * coalesce((SELECT sum(g) / nullif(sum(m), 0) FROM t), 1.0)) / (sum(m) + 4.0::DOUBLE) AS hp FROM t GROUP BY host),
p AS (SELECT t.host, node, (g + 4.0::DOUBLE * hp) / (m + 4.0::DOUBLE) AS purity FROM t JOIN h ON t.host = h.host)
SELECT page_id, l.host, path, {names} AS rule, coalesce({says}, CASE WHEN purity < 0.6 THEN 'block' ELSE 'allow' END) AS verdict,
       l.host || l.node AS template, round(purity, 6) AS purity
FROM l{depth} l JOIN p ON l.host = p.host AND l.node = p.node""")
    return "WITH " + ",\n".join(parts)


def _by_length() -> list[tuple[str, str]]:
    return sorted(RULES, key=lambda r: (-len(r[0]), r[0]))


REPORT_SQL = _sql()
