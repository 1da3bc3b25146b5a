"""Site-relative line deduplication.

A line is boilerplate of a host if it stands on more than `ratio` of the host's pages (and on `min_pages` at least, a parameter that is 1 unless it is set: then each
line of a host with fewer than 1 / ratio pages is boilerplate). Pages are counted by host and distinct line, summed before the shuffle, so a host with a third of all
pages is no hot key. As a page has a bounded number of lines on average, a host has at most (mean distinct lines a page) / ratio boilerplate lines; that short
list is written and meets the host's pages, and each page drops the lines in place. Where Spark finds the lists small enough to broadcast, no page is shuffled; else hosts with more
than a 1 / PARTS of all pages, PARTS at most, meet theirs in parts.

Lines are compared by 64-bit hash. Defined cases: null text is a page without lines, null host a host of its own. Blank lines are neither counted nor kept.
A line that repeats on a page counts once and is dropped everywhere. Repeated page rows count each. Very long pages are one row each, whole. An empty table has an empty result. Further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Stage, clean_text, pick

#: A host with more than 1 / PARTS of all pages meets its lines in parts.
PARTS = 1000
TAG = r"<[^>]*>"
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def html_lines(html: Column) -> Column:
    """The text between tags, by tag and line end."""
    return lines_of(F.regexp_replace(clean_text(html), TAG, "\n"))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(clean_text(text), "\n"), lambda l: F.regexp_replace(l, EDGE, "")), lambda l: l != "")


def site_line_dedup(pages: DataFrame, id_col: str, host: Column, lines: Column, ratio: float = 0.1, min_pages: int = 1) -> DataFrame:
    """id, host, n_lines, n_dropped and the text of what stays, one line a row of text."""
    stage = Stage(pages.sparkSession, "lines")
    rows = pages.select(pick(pages, id_col).alias("id"), host.alias("host"), lines.alias("lines"))
    hashed = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda l: F.xxhash64(l)))).alias("line"))
    counts = hashed.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.select(host.alias("th")).groupBy("th").agg(F.count("*").alias("total"))
    totals = stage.write("totals", totals)
    share = F.lit(totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] / PARTS)
    large = totals.where(F.col("total") > share).select(F.col("th").alias("lh"), F.ceil(F.col("total") / share).cast("int").alias("parts"))  # under PARTS rows
    common = counts.join(totals, F.col("host").eqNullSafe(F.col("th"))).where(F.col("pages") > F.col("total") * ratio)
    common = common.groupBy(F.col("host").alias("ch")).agg(F.collect_set("line").alias("bad"))  # at most mean lines / ratio a host
    common = stage.write("common", common.join(F.broadcast(large), F.col("ch").eqNullSafe(F.col("lh")), "left").select("ch", "bad", F.coalesce("parts", F.lit(1)).alias("parts")))
    common = common.select("ch", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cp"), "bad")
    rows = rows.join(F.broadcast(large), F.col("host").eqNullSafe(F.col("lh")), "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "lines"), F.coalesce("parts", F.lit(1))).cast("int"))
    out = rows.join(common, F.col("host").eqNullSafe(F.col("ch")) & (F.col("part") == F.col("cp")), "left")
    kept = F.filter("lines", lambda l: F.col("bad").isNull() | ~F.array_contains("bad", F.xxhash64(l)))
    out = out.withColumn("kept", kept)
    return out.select(F.col("id").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


REPORT_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN
             translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
             list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)),
               lambda l: regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda l: l <> '') AS lines FROM pages),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
bad AS (SELECT c.host, list(line) AS bad FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n > total * 0.1::DOUBLE GROUP BY c.host)
SELECT page_id, p.host, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(lines) - len(list_filter(lines, lambda l: bad IS NULL OR NOT list_contains(bad, l))) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(list_filter(lines, lambda l: bad IS NULL OR NOT list_contains(bad, l)), chr(10)), '') AS text
FROM p LEFT JOIN bad ON p.host IS NOT DISTINCT FROM bad.host
"""
