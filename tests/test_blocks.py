"""Sections and evidence blocks of random Markdown: the queries against their SQL."""

import random

import duckdb
import pytest

from rankloom.plans.catalogue import QUERIES, SQL

LINES = ["# A", "## B b", "### C", "#### D ", "##### E", "#no", "text", "  indented", "- item", "  - sub", "1. one", "```", "~~~py", "> q", "| a | b |", "|---|---|", "", "   ", "\t", "<!-- c -->", "<!-- c", "more ", "* x", "a|b"]


@pytest.fixture(scope="module")
def markdown(spark, tmp_path_factory):
    rng, at = random.Random(3), tmp_path_factory.mktemp("markdown")
    docs = [(i, rng.choice(["\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randrange(30))) + rng.choice(["", "\n"])) for i in range(400)] + [(9999, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["evidence_blocks", "document_sections"])
def test_queries_equal_their_sql(spark, markdown, name):
    got = QUERIES[name](spark, markdown)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{markdown}/documents.parquet/*.parquet'")
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(str([dict(zip(names, r, strict=True))[c] for c in got.columns]) for r in cursor.fetchall())
    assert sorted(str(list(r)) for r in got.collect()) == want and len(want) > 400
