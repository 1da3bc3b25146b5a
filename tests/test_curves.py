"""Curves of selective answering over corpora that hold every passage, or none: the queries against their SQL."""

import duckdb
import pytest

from rankloom.plans.catalogue import QUERIES, SQL

DOCS = [(0, "web", "red cats run over the hill"), (1, "web", "blue dogs run under the hill"), (2, "news", "red dogs sleep"), (3, "news", None)]
#: Items whose passages are all in the documents, in none of them, in some; and no items.
ITEMS = {"all": ["cats run over", "dogs run under the", "red dogs sleep"], "none": ["cats run under", "dogs sleep over the"], "some": ["cats run over", "dogs sleep over the"], "empty": []}


@pytest.fixture(scope="module", params=ITEMS)
def tables(request, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    spark.createDataFrame(DOCS, "doc_id long, source string, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS[request.param])), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["risk_coverage_curve", "select_operating_point"])
def test_curves_equal_their_sql(spark, tables, name):
    got = QUERIES[name](spark, tables)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    cursor = con.execute(SQL[name])
    assert got.columns == [c[0] for c in cursor.description]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in cursor.fetchall())
