"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import math
import re

import duckdb
import pytest

from vigia import model_queries, more_queries, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()[:19]
    return value


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


PART = re.compile(r"FROM \w+ WHERE \w+ (?:% \d+ = 0|> 400000)")


def test_queries_read_whole_tables(spark, duck, sf_dir):
    assert not [name for name, sql in queries.ORACLE_SQL.items() if PART.search(sql)]
    days = duck.sql("select count(*) from (select distinct l_linenumber, cast(l_shipdate as date) from lineitem)").fetchall()[0][0]
    assert queries.QUERIES["heat_flags"](spark, sf_dir).count() == days
    assert queries.flagship(spark, sf_dir).agg({"n": "sum"}).first()[0] == duck.sql("select count(*) from orders").fetchall()[0][0]


def test_flagship(spark, sf_dir):
    assert queries.flagship(spark, sf_dir).count() > 0


def test_exposure_is_one_shuffle_and_no_range_join(spark, sf_dir):
    plan = queries.QUERIES["clim_moving_window"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_filter_reaches_the_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from vigia.operators.filters import filter_diagnosis

    df = filter_diagnosis(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_type").alias("icd")), "icd", ["J10"])
    assert "StringStartsWith" in df._jdf.queryExecution().executedPlan().toString()
