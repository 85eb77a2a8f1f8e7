"""The operators' queries against their SQL on the smallest tables."""

import duckdb
import pytest

from vigia.llm.queries import ORACLE_SQL, QUERIES


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)
