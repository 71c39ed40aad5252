"""Federation semantics on SQLite sources: the expected values of the federation's own fixtures."""

import os
import sqlite3
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.errors import FederationError, UnsupportedOperation
from tributary.functions.predicates import bind, glob, glob_to_regex, match, sql_like
from tributary.operators.federate import ERRORS, ROWID, SOURCE, ordered, pack_rowid, select_visible, unpack_rowid
from tributary.operators.scanner import Scanner
from tributary.plans.cache import ResultCache
from tributary.plans.engine import FederationEngine
from tributary.sources.registry import Registry
from tributary.sources.schema import affinity, parse_override
from tributary.streaming.refresh import Refresher

EVERYONE = "Alice Bob Charlie Diana Eve Frank".split()
USERS = {
    alias: [(i, name, f"{name.lower()}@{host}.com") for i, name, host in rows]
    for alias, rows in {"east": zip((1, 2), EVERYONE, ("example", "east")), "west": zip((10, 11, 12), EVERYONE[2:], ("example", "west", "example")), "north": zip((20,), EVERYONE[5:], ("north",))}.items()
}
PEOPLE = "CREATE TABLE users (id INTEGER PRIMARY KEY, {}, {})".format


def write(path, ddl, rows):
    db = sqlite3.connect(path)
    db.execute(ddl)
    table = ddl.split()[2].split("(")[0]
    if rows:
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    db.commit()
    db.close()
    return str(path)


def users(tmp_path):
    registry = Registry()
    for i, (alias, rows) in enumerate(USERS.items()):
        registry.add_source(write(tmp_path / f"{alias}.db", PEOPLE("name TEXT", "email TEXT"), rows), alias, priority=i)
    registry.reload()
    return registry


@pytest.fixture
def engine(spark, tmp_path):
    out = FederationEngine(spark, users(tmp_path), warehouse=str(tmp_path / "warehouse"))
    out.create_federated_table("people", table="users")
    return out


def items(spark, tmp_path, sources, rows, values=lambda s, r, n: s * n + r, kind="REAL"):
    registry = Registry()
    for s in range(sources):
        data = [(r, f"cat_{r % 10}", values(s, r, rows)) for r in range(1, rows + 1)]
        registry.add_source(write(tmp_path / f"items_{s}.db", f"CREATE TABLE items (id INTEGER PRIMARY KEY, category TEXT, value {kind})", data), f"drain_{s}", priority=s)
    registry.reload()
    out = FederationEngine(spark, registry, warehouse=str(tmp_path / "warehouse"))
    out.create_federated_table("things", table="items")
    return out


def names(df):
    return [r["name"] for r in df.collect()]


def test_scan_and_sources(engine):
    rows = {r["name"]: r[SOURCE] for r in engine.table("people").collect()}
    assert len(rows) == 6 and rows["Alice"] == "east" and rows["Charlie"] == "west" and rows["Frank"] == "north"
    assert engine.query("people", source="west").count() == 3
    assert engine.query("people", source="nowhere").count() == 0
    assert engine.visible("people").columns == ["id", "name", "email"]


def test_predicates(engine):
    df = engine.table("people")
    assert df.filter(sql_like("email", "%@EXAMPLE.com")).count() == 3
    assert names(df.filter("name = 'Bob'")) == ["Bob"]
    assert "Alice" not in names(df.filter("name <> 'Alice'")) and df.filter("name <> 'Alice'").count() == 5
    assert df.filter(glob("email", "*@example.com")).count() == 3
    assert df.filter(F.col("name").isin("Alice", "Charlie", "Frank")).count() == 3
    with pytest.raises(UnsupportedOperation):
        match("name", "x")


def test_nulls(engine, tmp_path):
    db = sqlite3.connect(tmp_path / "east.db")
    db.execute("INSERT INTO users VALUES (3, 'NullEmail', NULL)")
    db.commit()
    db.close()
    df = engine.table("people")
    assert (df.filter("email IS NULL").count(), df.filter("email IS NOT NULL").count()) == (1, 6)


def test_rowids(engine, spark, tmp_path):
    ids = [r[ROWID] for r in engine.head("people", 10).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 6
    assert [unpack_rowid(i) for i in ids][:3] == [(1, 1), (1, 2), (2, 10)]
    again = FederationEngine(spark, engine.registry).create_federated_table("people", table="users")
    assert sorted(r[ROWID] for r in again.collect()) == ids
    assert names(engine.lookup("people", ids[0])) == ["Alice"]
    assert engine.lookup("people", pack_rowid(99, 1)).count() == 0
    assert pack_rowid(5, 7) == 5497558138887 and pack_rowid(1, -1) == pack_rowid(1, (1 << 40) - 1)


def test_order_and_limits(engine):
    assert names(engine.query("people", source="west", order_by="-name")) == ["Eve", "Diana", "Charlie"]
    assert names(engine.query("people", source="west", order_by="name", limit=2)) == ["Charlie", "Diana"]
    everyone = EVERYONE
    assert names(engine.query("people", order_by="name")) == everyone
    assert names(engine.query("people", order_by="-name")) == everyone[::-1]
    assert names(engine.query("people", order_by="name", limit=3)) == everyone[:3]
    assert names(engine.query("people", limit=2, offset=1)) == ["Bob", "Charlie"]
    assert names(engine.query("people", limit=10, offset=100)) == []
    assert names(engine.query("people", limit=0)) == []
    assert names(ordered(engine.table("people").withColumn("one", F.lit(1)), "one")) == everyone


def test_schemas(engine, tmp_path):
    registry = engine.registry
    registry.add_source(write(tmp_path / "odd.db", PEOPLE("full_name TEXT", "address TEXT"), []), "odd", priority=9)
    registry.reload()
    with pytest.raises(FederationError, match="schema mismatch in source"):
        engine.create_federated_table("people2", table="users")
    registry.set_active("odd", False)
    registry.add_source(str(tmp_path / "missing.db"), "missing", priority=10)
    registry.reload()
    df = engine.create_federated_table("people3", table="users")
    assert df.count() == 6 and {r[ERRORS] for r in df.collect()} == {1}
    assert engine.status("people3")["warnings"] and engine.source_errors("people3") == 1
    fourth = Registry()
    with pytest.raises(FederationError):
        engine.create_federated_table("none", table="users", registry_db=None) if fourth.sources() else FederationEngine(engine.spark, fourth).create_federated_table("none", table="users")
    with pytest.raises(FederationError):
        engine.create_federated_table("none", table="no_such_table")
    assert parse_override("a DECIMAL(10,2), b TEXT").names == ["a", "b"]
    assert parse_override("a DECIMAL(10,2), b TEXT")[0].dataType.simpleString() == "decimal(10,2)"
    with pytest.raises(FederationError):
        parse_override(" ")
    assert [affinity(x).simpleString() for x in ("BIGINT", "VARCHAR(3)", "", "REAL", "NUMERIC")] == ["bigint", "string", "binary", "double", "double"]


def test_first_source_must_open(spark, tmp_path):
    registry = Registry()
    registry.add_source(str(tmp_path / "none.db"), "none")
    registry.reload()
    with pytest.raises(FederationError):
        FederationEngine(spark, registry).create_federated_table("t", table="users")


def test_lost_source_is_skipped_and_counted(engine, tmp_path):
    os.remove(tmp_path / "north.db")
    df = engine.query("people", order_by="name")
    assert names(df) == EVERYONE[:5]
    assert {r[ERRORS] for r in df.collect()} == {1}


def test_snapshot(engine, spark, tmp_path):
    engine.create_federated_table("snap", table="users", mode="snapshot")
    df = engine.table("snap")
    assert (df.count(), df.filter("name = 'Alice'").count(), df.filter(sql_like("email", "%@example.com")).count()) == (6, 1, 3)
    assert engine.query("snap", source="west").count() == 3 and engine.query("snap", limit=3).count() == 3 and engine.query("snap", limit=2, offset=2).count() == 2
    ids = {r[ROWID] for r in df.collect()}
    assert len(ids) == 6 and 0 not in ids
    os.remove(tmp_path / "north.db")
    again = FederationEngine(spark, engine.registry, warehouse=str(tmp_path / "warehouse"))
    assert again.open_snapshot("snap", table="users").count() == 6
    folder = engine._get("snap").snapshot.path
    engine.drop_table("snap")
    assert not os.path.exists(folder)


def test_wide_fan_out(spark, tmp_path):
    engine = items(spark, tmp_path, 5, 100)
    assert engine.table("things").filter("category = 'cat_0'").count() == 50
    values = [r["value"] for r in engine.query("things", "category = 'cat_1'", order_by="value").collect()]
    assert len(values) == 50 and values == sorted(values)
    assert engine.query("things", "category = 'cat_0'", limit=20).count() == 20
    assert engine.query("things", "category = 'cat_0'", limit=5, offset=3).count() == 5
    full = [r["value"] for r in engine.query("things", order_by="value").collect()]
    assert len(full) == 500 and [r["value"] for r in engine.query("things", order_by="value", limit=15).collect()] == full[:15]
    assert [r["value"] for r in engine.query("things", order_by="-value", limit=10).collect()] == full[::-1][:10]
    # A repeated query with an offset is offset again.
    for _ in range(2):
        assert [r["value"] for r in engine.query("things", order_by="value", limit=5, offset=3).collect()] == full[3:8]
    os.remove(tmp_path / "items_3.db")
    os.remove(tmp_path / "items_4.db")
    engine.flush_cache("things")
    assert engine.table("things").filter("category = 'cat_0'").count() == 30


def test_integers_beyond_doubles(spark, tmp_path):
    engine = items(spark, tmp_path, 2, 10, lambda s, r, n: 2**53 + s * 20 + r - 1, "INTEGER")
    values = [r["value"] for r in engine.query("things", order_by="value").collect()]
    assert values == [2**53 + s * 20 + i for s in range(2) for i in range(10)]


def test_aggregates(spark, tmp_path):
    engine = items(spark, tmp_path, 3, 100)
    assert engine.count("things") == 300 and engine.count("items", "category = 'cat_0'") == 30
    assert (engine.sum("things", "value"), engine.avg("things", "value"), engine.min("things", "value"), engine.max("things", "value")) == (45150.0, 150.5, 1.0, 300.0)
    assert engine.count("things", "category = 'none'") == 0 and engine.sum("things", "value", "category = 'none'") is None
    assert isinstance(engine.sum("things", "id"), float) and engine.max("things", "category") == "cat_9"
    for bad in (("things", None), ("things", "no_such_column"), (None, "value"), ("no_such_table", "value")):
        with pytest.raises(FederationError):
            engine.sum(*bad)


def test_scanner(spark, tmp_path):
    engine = items(spark, tmp_path, 3, 100)
    scan = engine.scan("things")
    assert scan.value(0) is None and scan.int64(0) == 0 and scan.columns == ["id", "category", "value"]
    seen = []
    assert scan.each(lambda s: seen.append((s.source_alias, s.rowid, s.double(2), s.text(1))) or (7 if len(seen) == 150 else 0)) == 7
    assert len(seen) == 150 and seen[0] == ("drain_0", 1, 1.0, "cat_1") and seen[-1][0] == "drain_1"
    with pytest.raises(FederationError):
        scan.filter("id = 1")
    bound = Scanner(spark, engine.registry, "items").filter("category = ?").bind(1, "cat_0")
    assert sum(1 for _ in iter(bound.next, False)) == 30 and not bound.next()
    assert engine.scan("things").filter("value > ? AND value <= ?").bind(1, 40).bind(2, 60).to_df().count() == 20
    assert engine.scan("things").parallel(lambda row: 0) == 300
    assert engine.scan("things").parallel(lambda row: row["id"] >= 10) == 30
    with pytest.raises(FederationError):
        engine.scan("things").bind(1, 2)
    with pytest.raises(FederationError):
        Scanner(spark, engine.registry, "nothing")


def test_bind_leaves_quoted_marks():
    assert bind("a = ? AND b = '?' AND c < ?", ["x'y", 1.5]) == "a = 'x\\'y' AND b = '?' AND c < CAST('1.5' AS DOUBLE)"
    with pytest.raises(ValueError):
        bind("a = ?", [])
    with pytest.raises(ValueError):
        bind("a = 1", [2])


def test_result_cache(engine):
    own = engine._get("people").cache
    engine.query("people", "name = 'Bob'")
    engine.query("people", "name = 'Bob'")
    assert (own.hits, own.misses, engine.status("people")["l1"]["entries"]) == (1, 1, 1)
    # Another order or another list of values is another query.
    assert names(engine.query("people", "id > 1", order_by="name")) == names(engine.query("people", "id > 1", order_by="-name"))[::-1]
    assert engine.query("people", "name IN ('Bob')").count() == 1 and engine.query("people", "name IN ('Eve')").count() == 1
    engine.flush_cache("people")
    assert engine.status("people")["l1"]["entries"] == 0 and own.hits == 1
    engine.query("people")
    assert engine.status("people")["l1"]["entries"] == 0  # unconstrained scans aren't kept


def test_result_cache_budget_and_time(spark):
    now = [0.0]
    cache = ResultCache(max_rows=2, ttl=10, clock=lambda: now[0])
    one, two, three, many = (spark.range(a, b) for a, b in ((0, 1), (5, 6), (7, 8), (0, 9)))
    assert not cache.put(many, many.toArrow())
    for df in (one, two):
        assert cache.put(df, df.toArrow())
    assert cache.get(one).num_rows == 1
    cache.put(three, three.toArrow())
    assert cache.get(two) is None and cache.get(one) is not None
    now[0] = 11
    assert cache.get(one) is None and cache.evict_expired() == 1


def test_refreshed_copy(spark, tmp_path):
    registry = users(tmp_path)
    engine = FederationEngine(spark, registry)
    engine.create_federated_table("people", table="users", cache_db=str(tmp_path / "copy"))
    assert engine.status("people")["l2_active"] == 1 and not engine.status("people")["l2"]["fresh"]
    assert set(engine.refresh("people").values()) == {"copied"}
    assert engine.copied("people").count() == 6 and engine.status("people")["l2"]["fresh"]
    assert set(engine.refresh("people").values()) == {"kept"}
    db = sqlite3.connect(tmp_path / "north.db")
    db.execute("INSERT INTO users VALUES (99, 'New', NULL)")
    db.commit()
    db.close()
    os.remove(tmp_path / "west.db")
    done = engine.refresh("people")
    assert done == {"east": "kept", "west": "stale", "north": "copied"} and engine.copied("people").count() == 7
    registry.set_active("east", False)
    registry.reload()
    assert engine.refresh("people")["east"] == "dropped"
    assert {r[SOURCE] for r in engine.copied("people").collect()} == {"west", "north"}
    assert engine.query("people", "name = 'Charlie'").count() == 1  # a fresh copy answers


def test_background_refresh(spark, tmp_path):
    engine = FederationEngine(spark, users(tmp_path))
    engine.create_federated_table("people", table="users", cache_db=str(tmp_path / "copy"))
    with Refresher(engine, "people", seconds=0.2) as own:
        until = time.time() + 60
        while own.rounds < 2 and time.time() < until:
            time.sleep(0.1)
    assert own.rounds >= 2 and own.error is None and engine.copied("people").count() == 6


def test_registry(tmp_path):
    path = str(tmp_path / "registry.db")
    assert FederationEngine.init_registry(path) == "ok" and FederationEngine.init_registry(path) == "ok"
    registry = Registry(path)
    for i in range(5):
        registry.add_source(f"/tmp/source_{i}.db", f"source_{i}", priority=-i)
    with pytest.raises(FederationError):
        registry.add_source("/tmp/other.db", "source_1")
    assert registry.sources() == ()  # seen after a reload
    held = registry.sources()
    registry.reload()
    assert [s.alias for s in registry.sources()] == [f"source_{i}" for i in range(4, -1, -1)] and held == ()
    registry.set_override("source_2", "users", False)
    registry.set_override("source_3", "users", True)
    registry.reload()
    assert len(registry.sources("users")) == 4 and len(registry.sources("items")) == 5
    with pytest.raises(FederationError):
        Registry(str(tmp_path / "nothing.db"))
    os.remove(path)
    assert not registry.reload() and len(registry.sources("items")) == 5
    slow = Registry(None, reload_seconds=0.05)
    slow.add_source("/tmp/a", "a")
    time.sleep(0.06)
    assert len(slow.sources()) == 1


def test_configuration(engine):
    for bad in ({"mode": "odd"}, {"l1_max_rows": -1}, {"pool_max_open": "abc"}, {"l2_refresh_sec": 0}, {"l1_max_rows": True}):
        with pytest.raises(ValueError):
            engine.create_federated_table("t", table="users", **bad)
    with pytest.raises(ValueError):
        engine.create_from_args("t", ["table=users", "colour=red"])
    with pytest.raises(ValueError):
        engine.create_from_args("t", ["table=users", "l1_max_rows=1x"])
    assert engine.create_from_args("t", ["table='users'", "mode=live", "ignored", "l1_max_rows=20000"]).count() == 6
    assert engine.status("t")["l1"]["max_bytes"] == 64 << 20 and engine.status("t")["l2_active"] == 0
    assert engine.create_federated_table("o", table="users", schema="id BIGINT, name STRING").columns[:2] == ["id", "name"]
    assert engine.count("t") == 6
    with pytest.raises(FederationError):
        engine.status("unknown")


def test_sql_sees_registry_changes(engine, tmp_path):
    assert engine.sql("SELECT count(*) FROM people").first()[0] == 6
    engine.add_source("people", write(tmp_path / "south.db", PEOPLE("name TEXT", "email TEXT"), [(99, "Zed", None)]), "south", priority=9)
    engine.reload_registry("people")
    assert engine.sql("SELECT count(*) FROM people WHERE _source_db = 'south'").first()[0] == 1
    assert engine.sql("SELECT a.name FROM people a JOIN people b ON a.id = b.id + 1").count() == 3


def test_like_and_glob_on_odd_patterns(spark):
    df = spark.createDataFrame([("ALICE",), ("É",), ("50%",), ("a\\b",), ("a]b",), ("a\nb",), (None,)], "s string")
    hits = lambda c: sorted(r["s"] for r in df.filter(c).collect())
    assert hits(sql_like("s", "alice")) == ["ALICE"] and hits(sql_like("s", "é")) == []
    assert hits(sql_like("s", "50!%", "!")) == ["50%"] and hits(sql_like("s", "a\\b")) == ["a\\b"]
    assert hits(sql_like("s", None)) == []
    assert hits(glob("s", "a?b")) == ["a\nb", "a\\b", "a]b"] and hits(glob("s", "a[]]b")) == ["a]b"]
    assert hits(glob("s", "[^A]*")) == ["50%", "a\nb", "a\\b", "a]b", "É"] and hits(glob("s", "a[")) == []
    assert glob_to_regex("a.b") == r"(?s)^a\.b\z"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.integers(1, 5), low=st.floats(0, 300_000), status=st.sampled_from("FOP"), limit=st.integers(0, 40), down=st.booleans())
def test_any_slicing_answers_like_the_whole(spark, sf, parts, low, status, limit, down):
    from tributary.plans.queries import sliced

    engine = sliced(spark, sf, parts=parts)
    where = f"o_totalprice >= {low!r} AND o_orderstatus = '{status}'"
    got = [r["o_orderkey"] for r in engine.query("fed", where, order_by=["-o_totalprice" if down else "o_totalprice", "o_orderkey"], limit=limit).collect()]
    price = F.desc("o_totalprice") if down else F.asc("o_totalprice")
    want = spark.read.parquet(f"{sf}/orders.parquet").filter(where).orderBy(price, "o_orderkey").limit(limit)
    assert got == [r["o_orderkey"] for r in want.collect()]


def test_parquet_folders_number_their_rows(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(0, 100, 1, 3).selectExpr("id", "id * 2 AS twice").write.parquet(path)
    registry = Registry()
    registry.add_source(path, "many")
    registry.reload()
    df = FederationEngine(spark, registry).create_federated_table("t", table="many")
    assert df.select(ROWID).distinct().count() == 100 and select_visible(df).columns == ["id", "twice"]


def test_like_and_glob_in_text(spark, tmp_path):
    """In conditions given as text they mean what they mean to SQLite; quoted parts, names and comments stay."""
    import random
    import sqlite3

    from tributary.functions.predicates import translate

    assert translate("`like` = 'a LIKE b' -- LIKE 'x'\n AND t.like LIKE NULL") == "`like` = 'a LIKE b' -- LIKE 'x'\n AND t.like LIKE NULL"
    assert translate("like(a, 'b') AND \"x GLOB 'y'\" = a") == "like(a, 'b') AND \"x GLOB 'y'\" = a" and translate("SHOW TABLES LIKE 'f*'") == "SHOW TABLES LIKE 'f*'"
    assert translate("a LIKE :p").startswith("a ILIKE")
    with pytest.raises(Exception, match="GLOB"):
        translate("a GLOB b")
    texts = ["ALICE", "alice", "Al%ce", "É", "é", "a\\b", "a.b", "", "x\ny", "it's", "50%", "[x]", "a_c", "abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string").createOrReplaceTempView("like_texts")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (s TEXT)")
    db.executemany("INSERT INTO t VALUES (?)", [(t,) for t in texts])
    rng = random.Random(4)
    pieces = ["%", "_", "a", "A", "l", "*", "?", "[a-c]", "[^x]", ".", "%ce", "É", "'", "c", "!%", "x"]
    conditions = ["s LIKE 'a\\\\b'", "s LIKE '50!%' ESCAPE '!'", "s NOT LIKE '%a%' AND s NOT GLOB '*[xX]*'", "(s || 'z') LIKE '%Z'", "CASE WHEN s LIKE 'a%' THEN 1 ELSE 0 END = 1", "s LIKE 'it''s'"]
    conditions += [f"s {rng.choice(['', 'NOT '])}{op} '{''.join(rng.choices(pieces, k=3)).replace(chr(39), chr(39) * 2)}'" for op in ("LIKE", "GLOB") for _ in range(40)]
    for condition in conditions:
        want = sorted(str(r[0]) for r in db.execute(f"SELECT s FROM t WHERE {condition.replace(chr(92) * 2, chr(92))}"))
        assert sorted(str(r[0]) for r in spark.sql(f"SELECT s FROM like_texts WHERE {translate(condition)}").collect()) == want, condition


def test_sources_lost_after_planning_are_left_out(spark, tmp_path):
    import os
    import sqlite3

    registry = Registry()
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(str(tmp_path / f"{k}.parquet"))
        registry.add_source(str(tmp_path / f"{k}.parquet"), f"p{k}", priority=k)
    registry.reload()
    df = FederationEngine(spark, registry, str(tmp_path)).create_federated_table("lost", table="t", key="id")
    for f in (tmp_path / "1.parquet").glob("*.parquet"):
        os.remove(f)
    for f in (tmp_path / "2.parquet").glob("*.parquet"):
        f.write_bytes(b"broken" * 20)
    assert sorted(r.id for r in df.collect()) == list(range(10))
    for k in range(2):
        db = sqlite3.connect(tmp_path / f"{k}.db")
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v REAL, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, i / 2 if i % 2 else i, "x" if i % 3 else None) for i in range(20)])
        db.commit(), db.close()
    files = Registry()
    for k in range(2):
        files.add_source(str(tmp_path / f"{k}.db"), f"d{k}", priority=k)
    files.reload()
    df = FederationEngine(spark, files, str(tmp_path)).create_federated_table("lost2", table="t")
    (tmp_path / "1.db").write_bytes(b"no database")
    assert df.count() == 20 and {r[0] for r in df.select("_source_db").distinct().collect()} == {"d0"}


def test_conditions_of_one_query_do_not_stay_for_the_next(spark, tmp_path):
    engine = items(spark, tmp_path, 2, 20)
    df = engine.table("things")
    for _ in range(2):
        assert df.filter("category = 'cat_1'").count() < df.count() == 40


def test_a_limit_reads_only_the_sources_it_needs(spark, tmp_path):
    registry = Registry()
    for k in range(5):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(str(tmp_path / f"{k}.parquet"))
        registry.add_source(str(tmp_path / f"{k}.parquet"), f"p{k}", priority=k)
    registry.reload()
    engine = FederationEngine(spark, registry, str(tmp_path))
    engine.create_federated_table("few", table="t", key="id")
    for n, scans in ((5, 1), (10, 1), (11, 2), (35, 4), (500, 5)):
        df = engine.head("few", n)
        assert [r.id for r in df.collect()] == list(range(min(n, 50)))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == scans
    assert [r.id for r in engine.query("few", limit=4, offset=18).collect()] == [18, 19, 20, 21]
