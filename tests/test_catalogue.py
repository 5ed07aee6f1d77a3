"""Every query against its SQL on the smallest tables, and checks of plans."""

from __future__ import annotations

import math

import pytest

from factloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def db():
    import duckdb

    out = duckdb.connect()
    for name in TABLES:
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return out


def plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return int(value) if value.is_integer() else value
    return str(value) if not isinstance(value, (int, type(None))) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert len(got.columns) == len(set(got.columns))
    if name in catalogue.ORACLE_SQL:
        want = db.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
        assert rows == sorted(repr([float(x) if type(x).__name__ == "Decimal" else plain(x) for x in r]) for r in want)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_they_need(spark):
    plan = plan_of(catalogue.QUERIES["reconcile_orders_vs_lines"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan
    plan = plan_of(catalogue.QUERIES["word_islands"](spark, SF))
    assert "p_retailprice" not in plan


def test_no_cartesian_products(spark):
    for name in ("reconcile_all_fields", "skipped_cells", "finalized_errors", "locate_pages_topk"):
        assert "CartesianProduct" not in plan_of(catalogue.QUERIES[name](spark, SF)), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
