"""The queries that SQL can express, against that SQL: on the smallest tables, and on edge cases written as tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from stratalith.llm.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'' if folder == DIR else '/*.parquet'}')")
    found = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in found.description)
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == names
    at = [[d[0] for d in found.description].index(n) for n in names]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def edge_dir(spark, edge, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    again = edge.where("doc_id in (8, 16)")
    docs = edge.unionByName(again).unionByName(edge.where("doc_id = 17").withColumn("doc_id", F.lit(None).cast("bigint")))
    docs.write.parquet(f"{folder}/documents.parquet")
    edge.select(F.col("doc_id").alias("item_id"), F.when(F.length("text") < 500, F.col("text")).alias("text")).write.parquet(f"{folder}/benchmark.parquet")
    edge.select(F.col("doc_id").alias("page_id"), F.lit("http://x.org/").alias("url"), F.col("text").alias("html")).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_on_tables(spark, name):
    compare(spark, name, DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_on_edge_cases(spark, name, edge_dir):
    compare(spark, name, edge_dir)
