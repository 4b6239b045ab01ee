"""The queries that SQL can express, against their SQL."""

import os

import duckdb
import odd
import oracle
import pytest

from millrace.llm.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_tables(spark, name):
    con = oracle.connect(FOLDER)
    assert oracle.compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """The odd documents with unique ids, as a folder of tables."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(n, t) for n, (_, t) in enumerate(odd.texts())]
    docs = odd.documents(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.selectExpr("doc_id as page_id", "case when doc_id = 3 then null else 'http://a/ b' end url",
                    "text as html", "lang", "id", "payload_x as payload"
                    if "payload_x" in docs.columns else "size as payload").write.parquet(
        f"{folder}/pages.parquet")
    labels(spark, [(1, 1, 0), (6, 1, 1), (6, 0, None), (9, None, 1), (None, 1, 1), (99, 1, 1)], folder)
    return folder


def labels(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_awkward_rows(spark, awkward, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"create view {table} as select * from "
                    f"read_parquet('{awkward}/{table}.parquet/*.parquet')")
    assert oracle.compare(spark, con, awkward, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    odd.documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    labels(spark, [], str(tmp_path))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
