"""Every federation query against DuckDB, and the shape of the plans."""

import os

import pyarrow.parquet as pq
import pytest
from support import same

from tributary.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_agrees_with_duckdb(name, spark, sf, duck):
    same(q.QUERIES[name](spark, sf).toPandas(), duck.execute(q.ORACLE_SQL[name]).fetchdf())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> int:
    return plan(df).count("FileScan parquet")


def test_predicates_on_the_source_drop_branches(spark, sf):
    fed = q._fed(spark, sf)
    assert scans(fed.filter("_source_db = 'src_1'")) == 1
    assert scans(fed.filter("_source_db <> 'src_1'")) == 3
    assert scans(fed.filter("_source_db LIKE '%_3'")) == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(q._fed(spark, sf).filter("o_totalprice > 100").select("o_custkey", "_source_db"))
    assert "GreaterThan(o_totalprice,100.0)" in text
    assert "o_orderpriority" not in text


def test_top_k_and_lookup(spark, sf):
    engine = q.sliced(spark, sf)
    assert "TakeOrderedAndProject" in plan(engine.table("fed").orderBy("o_totalprice").limit(5))
    found = engine.lookup("fed", q.pack_rowid(3, 18))
    assert scans(found) == 1 and "EqualTo(o_orderkey,18)" in plan(found)


def test_aggregates_are_partial_before_the_exchange(spark, sf):
    text = plan(q.sliced(spark, sf).aggregate_df("sum", "fed", "o_totalprice"))
    assert text.index("Exchange SinglePartition") < text.index("partial_sum")


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("step", [1, 4])
def test_slices_are_written_in_tasks_of_few_rows(spark, tmp_path, monkeypatch, step):
    """However many rows a slice has, even if it has all of them, or the keys recur at regular places; every row is written once."""
    monkeypatch.setattr(q, "SLICE_ROWS", 500, raising=False)
    rows = spark.range(6000).selectExpr(f"if(id % 1000 = 7, NULL, id * {step}) AS o_orderkey", "id % 3 AS o_custkey")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    root = q._slices(spark, str(tmp_path), "orders", "o_orderkey", 4)
    files = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    assert max(pq.read_metadata(f).num_rows for f in files) <= 650
    written = spark.read.parquet(root)
    assert written.filter("slice <> pmod(o_orderkey, 4) OR (slice IS NULL) <> (o_orderkey IS NULL)").count() == 0
    assert not written.drop("slice").exceptAll(rows).count() and written.count() == 6000


@pytest.mark.parametrize("name", ["agg_rollup", "fed_sql_view", "join_anti"])
def test_results_over_slices_of_many_tasks(name, spark, sf, duck, monkeypatch):
    monkeypatch.setattr(q, "SLICE_ROWS", 100, raising=False)
    monkeypatch.setattr(q, "_WRITTEN", {})
    same(q.QUERIES[name](spark, sf).toPandas(), duck.execute(q.ORACLE_SQL[name]).fetchdf())
    files = [os.path.join(d, f) for root in q._WRITTEN.values() for d, _, names in os.walk(root.removeprefix("file://")) for f in names if f.endswith(".parquet")]
    assert files and max(pq.read_metadata(f).num_rows for f in files) <= 150
