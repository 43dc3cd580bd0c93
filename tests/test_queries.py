"""Every registry query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from routeloom.plans import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    want = con.execute(q.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(str([plain(r[k]) for k in at]) for r in want.fetchall())
    df = q.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted(str([plain(x) for x in r]) for r in df.select(*columns).collect())
    assert rows, "an empty answer tests nothing"
    assert got == rows


def test_inlined_filter_sets_of_any_part_key(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * FROM (VALUES (5, 5), (999999, 1), (1000000, 7), (1000001, 7), (10000000, 10)) t(p_partkey, p_size)) TO '{tmp_path}/part.parquet'")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{SF}/supplier.parquet'")
    name = "inlined_filter_sets"
    want = sorted(map(tuple, c.execute(q.oracle_sql()[name]).fetchall()))
    assert len(want) == 5
    assert sorted(map(tuple, q.queries()[name](spark, str(tmp_path)).select("id", "literals").collect())) == want


def test_queries_without_sql_have_rows(spark):
    for name in set(q.queries()) - set(q.oracle_sql()):
        assert q.queries()[name](spark, SF).limit(1).count() == 1, name
