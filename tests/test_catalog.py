"""The catalogue imports without the llm subpackage's help, and core queries agree with their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from wicker.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SHORT = [
    "answer_items", "answer_blockers", "candidate_pool", "match_longest", "parse_quantity", "to_grams", "group_split", "alternate_split",
    "mask_items", "graph_neighbors", "jaccard_match", "stream_item_df",
]


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


def compare(spark, name, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=repr), name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SHORT)
def test_agrees_with_sql(spark, name):
    compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
