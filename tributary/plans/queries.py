"""The federation's queries over the test tables, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

import functools
import math
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.predicates import glob, regexp, sql_like
from tributary.operators.federate import ERRORS, RANK, ROWID, SOURCE, pack_rowid
from tributary.plans.engine import FederationEngine
from tributary.sources.files import Files
from tributary.sources.registry import Registry

PARTS = 4
#: Rows of a slice that one task writes, some 200 MB in memory.
SLICE_ROWS = 1_250_000


_WRITTEN: dict[tuple, str] = {}


def _slices(spark: SparkSession, sf_dir: str, table: str, by: str, parts: int) -> str:
    """A folder in the shared one with the slices of a test table, written once a process."""
    shared = FederationEngine(spark)._folder("", "slices") if (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()) else _local()
    asked = (shared, sf_dir, table, by, parts)
    if asked not in _WRITTEN or not Files(spark).exists(_WRITTEN[asked]):
        path = f"{shared}/tributary-{table}-{parts}-{os.urandom(8).hex()}"
        slices = spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn("slice", F.expr(f"pmod({by}, {parts})"))
        _dealt(slices, parts).write.partitionBy("slice").parquet(path)
        _WRITTEN[asked] = path
    return _WRITTEN[asked]


def _dealt(slices: DataFrame, parts: int) -> DataFrame:
    """The rows in tasks of one slice and at most about SLICE_ROWS rows each, as many as every slice needs: a task sorts what it writes."""
    rows = {k: n for k, n in slices.groupBy("slice").count().collect()}
    tasks, task = 0, F
    for k in dict.fromkeys([*range(parts), *rows]):  # a row without a key has no slice
        own = max(1, math.ceil(rows.get(k, 0) / SLICE_ROWS))
        task = task.when(F.col("slice").eqNullSafe(F.lit(k)), tasks + F.pmod("_task", F.lit(own)))
        tasks += own
    # By a hash of the row's place: keys may recur at regular places, and rows may be equal.
    placed = slices.withColumn("_task", F.xxhash64(F.monotonically_increasing_id())).withColumn("_task", task.cast("int"))
    return placed.repartitionById(tasks, F.col("_task")).drop("_task")


@functools.lru_cache(maxsize=1)
def _local() -> str:
    """Where nothing names a shared folder, as in tests."""
    return tempfile.mkdtemp(prefix="tributary-")


def sliced(spark: SparkSession, sf_dir: str, table: str = "orders", key: str | None = "o_orderkey", by: str | None = None, parts: int = PARTS, **options) -> FederationEngine:
    """An engine with one federated table: slices of a test table, one a source with files of its own."""
    root = _slices(spark, sf_dir, table, by or key, parts)
    registry = Registry()
    for k in range(parts):
        registry.add_source(f"{root}/slice={k}", f"src_{k}", priority=k, format="parquet")
    registry.reload()
    engine = FederationEngine(spark, registry)
    engine.create_federated_table("fed", table=table, key=key, **options)
    return engine


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(spark, sf_dir).table("fed")


FED = "(SELECT *, 'src_' || (o_orderkey % 4) AS _source_db, 0 AS _source_errors, (CAST(o_orderkey % 4 + 1 AS BIGINT) << 40) | (o_orderkey & 1099511627775) AS _rowid, CAST(o_orderkey % 4 AS INTEGER) AS _source_rank FROM orders)"
_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "_source_db")
_LIST = ", ".join(_COLUMNS)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _predicate(name: str, condition: Callable[[], object], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _fed(spark, sf_dir).filter(condition()).select(*_COLUMNS)

    run.__name__ = name
    run.__doc__ = f"Federated rows where {sql}."
    query(f"SELECT {_LIST} FROM {FED} WHERE {sql}")(run)


# -- scans --


@query("""SELECT _source_db, count(*) AS n, round(sum(o_totalprice), 2) AS revenue, max(top) AS top
FROM (SELECT *, list(o_orderkey) OVER (PARTITION BY _source_db ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[1] AS top FROM """ + FED + """ WHERE o_orderstatus = 'F') GROUP BY _source_db""")
def fed_flagship(spark, sf_dir):
    """Orders and revenue of each source, with the key of its dearest order."""
    dearest = F.min_by("o_orderkey", F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))
    return _fed(spark, sf_dir).filter("o_orderstatus = 'F'").groupBy(SOURCE).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), dearest.alias("top"))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, _source_db, _source_errors, _rowid FROM {FED}")
def fed_scan(spark, sf_dir):
    return _fed(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", SOURCE, ERRORS, ROWID)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def fed_visible(spark, sf_dir):
    return sliced(spark, sf_dir).visible("fed")


@query(f"SELECT {_LIST} FROM {FED} WHERE _source_db = 'src_1' AND o_totalprice > 100000")
def fed_sql_view(spark, sf_dir):
    return sliced(spark, sf_dir).sql(f"SELECT {_LIST} FROM fed WHERE _source_db = 'src_1' AND o_totalprice > :p", {"p": 100000})


_predicate("fed_source_eq", lambda: F.col(SOURCE) == "src_2", "_source_db = 'src_2'")
_predicate("fed_source_ne", lambda: F.col(SOURCE) != "src_2", "_source_db <> 'src_2'")
_predicate("fed_source_in", lambda: F.col(SOURCE).isin("src_1", "src_3"), "_source_db IN ('src_1', 'src_3')")
_predicate("fed_source_like", lambda: F.col(SOURCE).like("%_3"), "_source_db LIKE '%_3'")


@query(f"SELECT {_LIST}, _rowid FROM {FED} WHERE _rowid = {pack_rowid(3, 42 * 4 + 2)}")
def fed_rowid_lookup(spark, sf_dir):
    return sliced(spark, sf_dir).lookup("fed", pack_rowid(3, 42 * 4 + 2)).select(*_COLUMNS, ROWID)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey < 0")
def fed_unknown_source(spark, sf_dir):
    return _fed(spark, sf_dir).filter(F.col(SOURCE) == "nowhere").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS _source_db, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def fed_named_sources(spark, sf_dir):
    """Each kind of event as a source of its own."""
    registry = Registry()
    for i, kind in enumerate(("click", "error", "purchase", "signup", "view")):
        registry.add_source(f"{sf_dir}/events.parquet", kind, priority=i, format="parquet", predicate=f"event_type = '{kind}'")
    registry.reload()
    engine = FederationEngine(spark, registry)
    return engine.create_federated_table("fed", table="events", key="event_id").groupBy(SOURCE).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT 's_' || printf('%02d', l_suppkey % 32) AS _source_db, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def fed_fan_out(spark, sf_dir):
    """Thirty-two sources."""
    root = _slices(spark, sf_dir, "lineitem", "l_suppkey", 32)
    registry = Registry()
    for k in range(32):
        registry.add_source(f"{root}/slice={k}", f"s_{k:02d}", priority=k, format="parquet")
    registry.reload()
    df = FederationEngine(spark, registry).create_federated_table("fed", table="lineitem", key="l_orderkey")
    return df.filter("l_discount > 0.05").groupBy(SOURCE).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# -- predicates --

_predicate("pred_eq", lambda: F.col("o_custkey") == 77, "o_custkey = 77")
_predicate("pred_ne", lambda: F.col("o_orderstatus") != "F", "o_orderstatus <> 'F'")
_predicate("pred_gt", lambda: F.col("o_totalprice") > 300000, "o_totalprice > 300000")
_predicate("pred_ge", lambda: F.col("o_orderkey") >= 14000, "o_orderkey >= 14000")
_predicate("pred_lt", lambda: F.col("o_orderkey") < 500, "o_orderkey < 500")
_predicate("pred_le", lambda: F.col("o_totalprice") <= 20000, "o_totalprice <= 20000")
_predicate("pred_between", lambda: F.col("o_totalprice").between(100000, 120000), "o_totalprice BETWEEN 100000 AND 120000")
_predicate("pred_like_ci", lambda: sql_like("o_orderpriority", "%uRGent"), "o_orderpriority ILIKE '%uRGent'")
_predicate("pred_glob", lambda: glob("o_orderpriority", "[1-3]-[HM]*"), "o_orderpriority GLOB '[1-3]-[HM]*'")
_predicate("pred_regexp", lambda: regexp("o_orderpriority", "^[24].*[A-Z]{4}"), "regexp_matches(o_orderpriority, '^[24].*[A-Z]{4}')")
_predicate("pred_in", lambda: F.col("o_custkey").isin(1, 5, 9, 13, 700), "o_custkey IN (1, 5, 9, 13, 700)")
_predicate("pred_is_null", lambda: F.nullif("o_orderpriority", F.lit("5-LOW")).isNull(), "nullif(o_orderpriority, '5-LOW') IS NULL")
_predicate("pred_is_not_null", lambda: F.nullif("o_orderpriority", F.lit("5-LOW")).isNotNull(), "nullif(o_orderpriority, '5-LOW') IS NOT NULL")
_predicate("pred_and_combined", lambda: (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 150000) & sql_like("o_orderpriority", "1%"), "o_orderstatus = 'O' AND o_totalprice > 150000 AND o_orderpriority LIKE '1%'")
_predicate("pred_or", lambda: (F.col("o_orderstatus") == "P") | (F.col("o_totalprice") < 5000), "o_orderstatus = 'P' OR o_totalprice < 5000")


@query(f"SELECT {_LIST} FROM {FED} WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def pred_raw_text(spark, sf_dir):
    """A condition given as text, with bound values."""
    return sliced(spark, sf_dir).query("fed", "o_orderstatus = ? AND o_totalprice > ?", args=["F", 250000.0]).select(*_COLUMNS)


# -- order and limits --


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.select("o_orderkey", "o_totalprice", SOURCE, F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(f"SELECT o_orderkey, o_totalprice, _source_db, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM (SELECT * FROM {FED} ORDER BY o_totalprice, o_orderkey LIMIT 500)")
def order_asc(spark, sf_dir):
    return _ranked(sliced(spark, sf_dir).query("fed", order_by=["o_totalprice", "o_orderkey"], limit=500), "o_totalprice", "o_orderkey")


@query(f"SELECT o_orderkey, o_totalprice, _source_db, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (SELECT * FROM {FED} ORDER BY o_totalprice DESC, o_orderkey LIMIT 500)")
def order_desc(spark, sf_dir):
    return _ranked(sliced(spark, sf_dir).query("fed", order_by=["-o_totalprice", "o_orderkey"], limit=500), F.desc("o_totalprice"), "o_orderkey")


@query(f"SELECT o_orderkey, o_totalprice, _source_db, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey) AS place FROM (SELECT * FROM {FED} ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey LIMIT 300)")
def order_multi(spark, sf_dir):
    df = sliced(spark, sf_dir).query("fed", order_by=["-o_orderstatus", "o_orderpriority", "o_orderkey"], limit=300)
    return _ranked(df, F.desc("o_orderstatus"), "o_orderpriority", "o_orderkey")


@query(f"SELECT {_LIST} FROM {FED} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf_dir):
    return sliced(spark, sf_dir).query("fed", order_by=["-o_totalprice", "o_orderkey"], limit=10).select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM {FED} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25")
def topk_offset(spark, sf_dir):
    return sliced(spark, sf_dir).query("fed", order_by=["-o_totalprice", "o_orderkey"], limit=10, offset=25).select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM {FED} WHERE _source_db = 'src_3' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def order_single_source(spark, sf_dir):
    return sliced(spark, sf_dir).query("fed", source="src_3", order_by=["-o_orderdate", "o_orderkey"], limit=20).select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM {FED} ORDER BY _source_rank, o_orderkey LIMIT 4000")
def limit_source_order(spark, sf_dir):
    return sliced(spark, sf_dir).head("fed", 4000).select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM {FED} WHERE o_orderstatus = 'F' ORDER BY _source_rank, o_orderkey LIMIT 15 OFFSET 5")
def limit_offset_filtered(spark, sf_dir):
    return sliced(spark, sf_dir).query("fed", "o_orderstatus = 'F'", limit=15, offset=5).select(*_COLUMNS)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM orders LIMIT 0)")
def limit_zero(spark, sf_dir):
    return sliced(spark, sf_dir).head("fed", 0).agg(F.count(F.lit(1)).alias("n"))


# -- aggregates --


def _aggregate(name: str, function: str, column: str | None, where: str | None, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sliced(spark, sf_dir).aggregate_df(function, "fed", column, where)
        return df.select(F.round("value", 2).alias("value")) if function in ("sum", "avg") else df

    run.__name__ = name
    query(sql)(run)


_aggregate("agg_count", "count", None, None, "SELECT CAST(count(*) AS BIGINT) AS value FROM orders")
_aggregate("agg_count_where", "count", None, "o_orderstatus = 'F'", "SELECT CAST(count(*) AS BIGINT) AS value FROM orders WHERE o_orderstatus = 'F'")
_aggregate("agg_count_none", "count", None, "o_orderstatus = 'X'", "SELECT CAST(count(*) AS BIGINT) AS value FROM orders WHERE o_orderstatus = 'X'")
_aggregate("agg_sum", "sum", "o_totalprice", None, "SELECT round(sum(o_totalprice), 2) AS value FROM orders")
_aggregate("agg_sum_integer", "sum", "o_custkey", "o_orderstatus = 'P'", "SELECT round(sum(CAST(o_custkey AS DOUBLE)), 2) AS value FROM orders WHERE o_orderstatus = 'P'")
_aggregate("agg_avg", "avg", "o_totalprice", None, "SELECT round(avg(o_totalprice), 2) AS value FROM orders")
_aggregate("agg_min", "min", "o_totalprice", None, "SELECT min(o_totalprice) AS value FROM orders")
_aggregate("agg_max", "max", "o_totalprice", "o_orderstatus = 'O'", "SELECT max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O'")
_aggregate("agg_max_text", "max", "o_orderpriority", None, "SELECT max(o_orderpriority) AS value FROM orders")


@query(f"SELECT _source_db, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS revenue, min(o_orderkey) AS first, max(o_orderkey) AS last FROM {FED} GROUP BY _source_db")
def agg_by_source(spark, sf_dir):
    return _fed(spark, sf_dir).groupBy(SOURCE).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query(f"SELECT _source_db, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM {FED} GROUP BY _source_db HAVING count(DISTINCT o_custkey) > 10")
def agg_distinct(spark, sf_dir):
    return _fed(spark, sf_dir).groupBy(SOURCE).agg(F.countDistinct("o_custkey").alias("customers")).filter("customers > 10")


@query(f"SELECT _source_db, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM {FED} GROUP BY ROLLUP (_source_db, o_orderstatus)")
def agg_rollup(spark, sf_dir):
    return _fed(spark, sf_dir).rollup(SOURCE, "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT _source_db, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {FED} GROUP BY CUBE (_source_db, o_orderpriority)")
def agg_cube(spark, sf_dir):
    return _fed(spark, sf_dir).cube(SOURCE, "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT _source_db, o_orderstatus, round(avg(o_totalprice), 2) AS mean FROM {FED} GROUP BY GROUPING SETS ((_source_db), (o_orderstatus))")
def agg_grouping_sets(spark, sf_dir):
    return sliced(spark, sf_dir).sql("SELECT _source_db, o_orderstatus, round(avg(o_totalprice), 2) AS mean FROM fed GROUP BY GROUPING SETS ((_source_db), (o_orderstatus))")


# -- what Spark SQL brings, over federated tables --


@query(f"SELECT c_mktsegment, _source_db, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS revenue FROM {FED} o JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def join_customer(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return _fed(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", SOURCE).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query(f"SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT * FROM {FED} WHERE _source_db = 'src_0') ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    customer, fed = spark.read.parquet(f"{sf_dir}/customer.parquet"), _fed(spark, sf_dir).filter(F.col(SOURCE) == "src_0")
    return customer.join(fed, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM {FED} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(spark, sf_dir):
    customer, fed = spark.read.parquet(f"{sf_dir}/customer.parquet"), _fed(spark, sf_dir).filter("o_totalprice > 250000")
    return customer.join(fed, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM {FED} WHERE o_custkey = c_custkey AND _source_db = 'src_1')")
def join_anti(spark, sf_dir):
    customer, fed = spark.read.parquet(f"{sf_dir}/customer.parquet"), _fed(spark, sf_dir).filter(F.col(SOURCE) == "src_1")
    return customer.join(fed, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"SELECT a.o_custkey AS o_custkey, CAST(count(*) AS BIGINT) AS pairs FROM {FED} a JOIN {FED} b ON a.o_custkey = b.o_custkey WHERE a._source_db = 'src_0' AND b._source_db = 'src_1' GROUP BY a.o_custkey")
def cross_source_self_join(spark, sf_dir):
    a, b = (_fed(spark, sf_dir).filter(F.col(SOURCE) == s).select("o_custkey") for s in ("src_0", "src_1"))
    return a.join(b, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"SELECT a.o_custkey AS left_key, b.o_custkey AS right_key FROM (SELECT o_custkey FROM {FED} WHERE _source_db = 'src_0' AND o_orderkey < 400) a FULL JOIN (SELECT o_custkey FROM {FED} WHERE _source_db = 'src_1' AND o_orderkey < 400) b ON a.o_custkey = b.o_custkey")
def join_full(spark, sf_dir):
    fed = _fed(spark, sf_dir).filter("o_orderkey < 400")
    a, b = fed.filter(F.col(SOURCE) == "src_0").select(F.col("o_custkey").alias("left_key")), fed.filter(F.col(SOURCE) == "src_1").select(F.col("o_custkey").alias("right_key"))
    return a.join(b, F.col("left_key") == F.col("right_key"), "full")


@query(f"SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM region, nation CROSS JOIN (SELECT * FROM {FED} WHERE o_orderkey < 8) WHERE n_regionkey < r_regionkey GROUP BY r_name, n_name")
def join_cross_theta(spark, sf_dir):
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    few = _fed(spark, sf_dir).filter("o_orderkey < 8").select("o_orderkey")
    return region.join(nation, F.col("n_regionkey") < F.col("r_regionkey")).crossJoin(few).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, o_totalprice, _source_db, place FROM (SELECT *, row_number() OVER (PARTITION BY _source_db ORDER BY o_totalprice DESC, o_orderkey) AS place FROM {FED}) WHERE place <= 3")
def window_topn_per_source(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy(SOURCE).orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _fed(spark, sf_dir).withColumn("place", place).filter("place <= 3").select("o_orderkey", "o_totalprice", SOURCE, "place")


@query(f"SELECT o_orderkey, _source_db, CAST(sum(o_custkey) OVER (PARTITION BY _source_db ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, lag(o_orderkey) OVER (PARTITION BY _source_db ORDER BY o_orderkey) AS before FROM {FED}")
def window_running_sum(spark, sf_dir):
    own = Window.partitionBy(SOURCE).orderBy("o_orderkey")
    return _fed(spark, sf_dir).select("o_orderkey", SOURCE, F.sum("o_custkey").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.lag("o_orderkey").over(own).alias("before"))


@query(f"SELECT o_orderkey, _source_db, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY _source_db ORDER BY o_orderkey) AS INTEGER) AS t FROM {FED} WINDOW w AS (PARTITION BY _source_db ORDER BY o_orderpriority)")
def window_ranks(spark, sf_dir):
    w, t = Window.partitionBy(SOURCE).orderBy("o_orderpriority"), Window.partitionBy(SOURCE).orderBy("o_orderkey")
    return _fed(spark, sf_dir).select("o_orderkey", SOURCE, F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(t).alias("t"))


def _keys(spark, sf_dir, source: str) -> DataFrame:
    return _fed(spark, sf_dir).filter(F.col(SOURCE) == source).select("o_custkey")


def _two(op: str) -> str:
    return f"SELECT o_custkey FROM {FED} WHERE _source_db = 'src_0' {op} SELECT o_custkey FROM {FED} WHERE _source_db = 'src_1'"


@query(_two("UNION"))
def set_union(spark, sf_dir):
    return _keys(spark, sf_dir, "src_0").union(_keys(spark, sf_dir, "src_1")).distinct()


@query(_two("INTERSECT"))
def set_intersect(spark, sf_dir):
    return _keys(spark, sf_dir, "src_0").intersect(_keys(spark, sf_dir, "src_1"))


@query(_two("EXCEPT"))
def set_except(spark, sf_dir):
    return _keys(spark, sf_dir, "src_0").subtract(_keys(spark, sf_dir, "src_1"))


@query(_two("EXCEPT ALL"))
def set_except_all(spark, sf_dir):
    return _keys(spark, sf_dir, "src_0").exceptAll(_keys(spark, sf_dir, "src_1"))


# -- copies and caches --


@query(f"SELECT {_LIST}, _rowid FROM {FED}")
def snapshot_scan(spark, sf_dir):
    return sliced(spark, sf_dir, mode="snapshot").table("fed").select(*_COLUMNS, ROWID)


@query(f"SELECT {_LIST} FROM {FED} WHERE _source_db = 'src_2' AND o_orderstatus = 'O'")
def snapshot_filtered(spark, sf_dir):
    return sliced(spark, sf_dir, mode="snapshot").table("fed").filter((F.col(SOURCE) == "src_2") & (F.col("o_orderstatus") == "O")).select(*_COLUMNS)


def _copied(spark: SparkSession, sf_dir: str) -> FederationEngine:
    engine = sliced(spark, sf_dir, cache_db=os.path.join(FederationEngine(spark)._folder("", "copies"), os.urandom(8).hex()))
    engine.refresh("fed")
    return engine


@query(f"SELECT {_LIST}, _rowid FROM {FED}")
def l2_scan(spark, sf_dir):
    return _copied(spark, sf_dir).copied("fed").select(*_COLUMNS, ROWID)


@query(f"SELECT {_LIST}, _rowid FROM {FED} WHERE _source_db <> 'src_3'")
def l2_after_refresh(spark, sf_dir):
    """A source that is no longer registered goes with the next refresh; the others are kept as they are."""
    engine = _copied(spark, sf_dir)
    engine.registry.set_active("src_3", False)
    engine.reload_registry("fed")
    engine.refresh("fed")
    return engine.copied("fed").select(*_COLUMNS, ROWID)


@query(f"SELECT {_LIST} FROM {FED} WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def l2_query(spark, sf_dir):
    return _copied(spark, sf_dir).query("fed", "o_totalprice > 200000", order_by=["-o_totalprice", "o_orderkey"], limit=50).select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM {FED} WHERE o_custkey < 20")
def l1_repeat(spark, sf_dir):
    """The second of two equal queries."""
    engine = sliced(spark, sf_dir)
    engine.query("fed", "o_custkey < 20")
    return engine.query("fed", "o_custkey < 20").select(*_COLUMNS)


# -- resilience --


def _changed(spark: SparkSession, sf_dir: str, change: Callable[[Registry], object]) -> FederationEngine:
    engine = sliced(spark, sf_dir)
    change(engine.registry)
    engine.reload_registry("fed")
    return engine


@query(f"SELECT {_LIST}, 1 AS _source_errors FROM {FED}")
def missing_source_skipped(spark, sf_dir):
    return _changed(spark, sf_dir, lambda r: r.add_source("/nowhere/orders.parquet", "gone", priority=9, format="parquet")).table("fed").select(*_COLUMNS, ERRORS)


@query(f"SELECT {_LIST} FROM {FED} WHERE _source_db <> 'src_1'")
def override_excludes_source(spark, sf_dir):
    return _changed(spark, sf_dir, lambda r: r.set_override("src_1", "orders", False)).table("fed").select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM {FED} WHERE _source_db <> 'src_2'")
def inactive_source_excluded(spark, sf_dir):
    return _changed(spark, sf_dir, lambda r: r.set_active("src_2", False)).table("fed").select(*_COLUMNS)


@query("SELECT 'src_' || k AS _source_db, CAST(3 - k AS INTEGER) AS _source_rank FROM range(4) t(k)")
def priority_order(spark, sf_dir):
    registry = Registry()
    for k in range(PARTS):
        registry.add_source(f"{sf_dir}/orders.parquet", f"src_{k}", priority=-k, format="parquet", predicate=f"o_orderkey % 4 = {k}")
    registry.reload()
    engine = FederationEngine(spark, registry)
    engine.create_federated_table("fed", table="orders", key="o_orderkey")
    return engine.table("fed").select(SOURCE, RANK).distinct()


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, 'src_' || (o_orderkey % 2) AS _source_db FROM orders")
def schema_override(spark, sf_dir):
    registry = Registry()
    for k in range(2):
        registry.add_source(f"{sf_dir}/orders.parquet", f"src_{k}", priority=k, format="parquet", predicate=f"o_orderkey % 2 = {k}")
    registry.reload()
    df = FederationEngine(spark, registry).create_federated_table("fed", table="orders", key="o_orderkey", schema="o_orderkey BIGINT, o_totalprice DOUBLE")
    return df.select("o_orderkey", "o_totalprice", SOURCE)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice, o_orderstatus, 'db_' || (o_orderkey % 2) AS _source_db FROM orders WHERE o_orderkey < 400")
def sqlite_sources(spark, sf_dir):
    """Two SQLite files, made from orders, as sources."""
    import sqlite3

    folder = FederationEngine(spark)._folder(os.urandom(8).hex(), "sqlite").removeprefix("file://")
    os.makedirs(folder)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey < 400").select("o_orderkey", "o_totalprice", "o_orderstatus").collect()
    registry = Registry()
    for k in range(2):
        path = os.path.join(folder, f"{k}.db")
        db = sqlite3.connect(path)
        db.execute("CREATE TABLE orders (o_orderkey INTEGER PRIMARY KEY, o_totalprice REAL, o_orderstatus TEXT)")
        db.executemany("INSERT INTO orders VALUES (?, ?, ?)", [tuple(r) for r in rows if r[0] % 2 == k])
        db.commit()
        db.close()
        registry.add_source(path, f"db_{k}", priority=k)
    registry.reload()
    return FederationEngine(spark, registry).create_federated_table("fed", table="orders").select("o_orderkey", "o_totalprice", "o_orderstatus", SOURCE)


@query(f"SELECT {_LIST} FROM {FED} WHERE o_totalprice BETWEEN 50000 AND 60000")
def scanner_filter(spark, sf_dir):
    """A bulk scan with bound values."""
    scan = sliced(spark, sf_dir).scan("fed").filter("o_totalprice >= ? AND o_totalprice <= ?").bind(1, 50000.0).bind(2, 60000.0)
    return scan.to_df().select(*_COLUMNS)


# -- LIKE and GLOB in text --


@query(f"SELECT {_LIST} FROM {FED} WHERE o_orderpriority ILIKE '%urgent' AND o_orderstatus NOT ILIKE 'f'")
def text_like_ci(spark, sf_dir):
    return sliced(spark, sf_dir).query("fed", "o_orderpriority LIKE '%urgent' AND o_orderstatus NOT LIKE ?", args=["f"]).select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM {FED} WHERE o_orderpriority GLOB '[1-3]-[HM]*' AND o_orderpriority NOT GLOB '*l*'")
def text_glob(spark, sf_dir):
    return sliced(spark, sf_dir).query("fed", "o_orderpriority GLOB '[1-3]-[HM]*' AND o_orderpriority NOT GLOB '*l*'").select(*_COLUMNS)


@query(f"SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {FED} WHERE o_orderpriority ILIKE '_-%i%' GROUP BY o_orderpriority")
def text_like_sql(spark, sf_dir):
    return sliced(spark, sf_dir).sql("SELECT o_orderpriority, count(*) AS n FROM fed WHERE o_orderpriority LIKE '_-%i%' GROUP BY o_orderpriority")


_aggregate("agg_where_glob", "count", None, "o_orderpriority GLOB '?-H*'", "SELECT CAST(count(*) AS BIGINT) AS value FROM orders WHERE o_orderpriority GLOB '?-H*'")


@query(f"SELECT {_LIST} FROM {FED} WHERE o_orderpriority ILIKE '5-l%'")
def scanner_like(spark, sf_dir):
    return sliced(spark, sf_dir).scan("fed").filter("o_orderpriority LIKE ?").bind(1, "5-l%").to_df().select(*_COLUMNS)


# -- what had no entry of its own --


@query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey <= 200) RIGHT JOIN (SELECT * FROM {FED} WHERE _source_db = 'src_2' AND o_orderkey < 2000) ON o_custkey = c_custkey")
def join_right(spark, sf_dir):
    customer, fed = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey <= 200"), _fed(spark, sf_dir).filter((F.col(SOURCE) == "src_2") & (F.col("o_orderkey") < 2000))
    return customer.join(fed, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


_WHOLE = "OVER (PARTITION BY _source_db ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"SELECT o_orderkey, _source_db, lead(o_orderkey, 2) OVER (PARTITION BY _source_db ORDER BY o_orderkey) AS after, first_value(o_orderkey) {_WHOLE} AS first, last_value(o_orderkey) {_WHOLE} AS last FROM {FED}")
def window_lead_first_last(spark, sf_dir):
    own = Window.partitionBy(SOURCE).orderBy("o_orderkey")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _fed(spark, sf_dir).select("o_orderkey", SOURCE, F.lead("o_orderkey", 2).over(own).alias("after"), F.first_value("o_orderkey").over(whole).alias("first"), F.last_value("o_orderkey").over(whole).alias("last"))


@query(_two("INTERSECT ALL"))
def set_intersect_all(spark, sf_dir):
    return _keys(spark, sf_dir, "src_0").intersectAll(_keys(spark, sf_dir, "src_1"))


@query(f"SELECT {_LIST}, _rowid FROM {FED} WHERE o_custkey < 100")
def snapshot_reopened(spark, sf_dir):
    """A snapshot that another engine made."""
    name = "fed_" + os.urandom(6).hex()
    made = sliced(spark, sf_dir)
    root = made._folder("", "reopened")
    first = FederationEngine(spark, made.registry, root)
    first.create_federated_table(name, table="orders", key="o_orderkey", mode="snapshot")
    return FederationEngine(spark, made.registry, root).open_snapshot(name, table="orders", key="o_orderkey").filter("o_custkey < 100").select(*_COLUMNS, ROWID)


@query("SELECT false AS there, 'live' AS mode, CAST(4 AS BIGINT) AS sources, CAST(0 AS BIGINT) AS l2_active")
def dropped_and_status(spark, sf_dir):
    """Whether a snapshot's files are there once its table is dropped; and what the status of another says."""
    engine = sliced(spark, sf_dir)
    engine.create_federated_table("snap", table="orders", key="o_orderkey", mode="snapshot")
    snapshot = engine._get("snap").snapshot
    engine.drop_table("snap")
    status = engine.status("fed")
    return spark.createDataFrame([(snapshot.exists, status["mode"], status["registry"]["sources"], status["l2_active"])], "there boolean, mode string, sources bigint, l2_active bigint")


@query(f"SELECT CAST(count(*) AS BIGINT) AS seen, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(_source_db) AS last FROM {FED} WHERE o_orderkey < 1000")
def scanner_each(spark, sf_dir):
    """A callback for every row, on the driver."""
    seen = []
    scan = sliced(spark, sf_dir).scan("fed").filter("o_orderkey < 1000")
    scan.each(lambda s: seen.append((s.int64(0), s.source_alias)))
    return spark.createDataFrame([(len(seen), sum(k for k, _ in seen), seen[-1][1])], "seen bigint, keys bigint, last string")


@query("SELECT CAST(count(*) AS BIGINT) AS handed FROM orders WHERE o_orderkey % 3 = 1")
def scanner_parallel(spark, sf_dir):
    """A callback for every row, in the tasks."""
    return spark.createDataFrame([(sliced(spark, sf_dir).scan("fed").filter("o_orderkey % 3 = 1").parallel(lambda row: None),)], "handed bigint")


@query("SELECT CAST(3 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS entries, CAST(1 AS BIGINT) AS hits, CAST(1 AS BIGINT) AS misses, CAST(0 AS BIGINT) AS flushed")
def l1_status(spark, sf_dir):
    """What the first cache tier says of two equal queries, and after a flush."""
    engine = sliced(spark, sf_dir)
    for _ in range(2):
        kept = engine.query("fed", order_by="o_orderkey", limit=3).count()
    status = engine.status("fed")["l1"]
    engine.flush_cache("fed")
    return spark.createDataFrame([(kept, status["entries"], status["hits"], status["misses"], engine.status("fed")["l1"]["entries"])], "kept bigint, entries bigint, hits bigint, misses bigint, flushed bigint")
