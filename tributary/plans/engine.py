"""The federation engine: federated tables by name, queries through the cache tiers, administration."""

from __future__ import annotations

import tempfile
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.errors import FederationError
from tributary.functions.predicates import bind, translate
from tributary.operators import aggregates
from tributary.operators.federate import ERRORS, RANK, ROWID, SOURCE, Federation, discover, federate, in_source_order, ordered, select_visible, unpack_rowid
from tributary.operators.scanner import Scanner
from tributary.plans.cache import MAX_BYTES, MAX_ROWS, ResultCache
from tributary.plans.materialize import REFRESH_SECONDS, RefreshedCopy, Snapshot
from tributary.sources.files import join
from tributary.sources.readers import OPENERS, ROW_NUMBER, fingerprint, rows_of
from tributary.sources.registry import Registry
from tributary.sources.schema import parse_override

MODES = ("live", "snapshot")
_INTS = ("l1_max_rows", "l1_max_bytes", "pool_max_open", "l2_refresh_sec")
_KEYS = ("registry_db", "table", "mode", "cache_db", *_INTS, "schema")


@dataclass
class Table:
    name: str
    table: str
    registry: Registry
    mode: str
    key: str | None
    given: T.StructType | None
    schema: T.StructType
    cache: ResultCache
    copy: RefreshedCopy | None
    snapshot: Snapshot | None
    warnings: list[str] = field(default_factory=list)
    #: The last plan, and the sources and marks of their files that it was built for.
    built: tuple[tuple, Federation] | None = None


class FederationEngine:
    """Federated tables of one Spark session.

    ``warehouse`` is the folder for snapshots and refreshed copies, one that all
    executors share; without it, it is ``spark.checkpoint.dir`` or, where that isn't
    set, a temporary folder (local runs).
    """

    def __init__(self, spark: SparkSession, registry: Registry | None = None, warehouse: str | None = None):
        self.spark, self.registry = spark, registry
        self._warehouse = warehouse
        self._tables: dict[str, Table] = {}
        self._lock = threading.RLock()

    def _folder(self, name: str, kind: str) -> str:
        if self._warehouse is None:
            shared = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
            if not shared and not self.spark.sparkContext.master.startswith("local"):
                raise ValueError("name a warehouse, or set spark.checkpoint.dir: a folder that all executors share")
            self._warehouse = shared or tempfile.mkdtemp(prefix="tributary-")
        return join(self._warehouse, f"{kind}-{name}")

    # -- tables --

    @staticmethod
    def init_registry(path: str) -> str:
        Registry.init(path)
        return "ok"

    def create_federated_table(
        self, name: str, *, table: str | None = None, registry_db: str | None = None, mode: str = "live", cache_db: str = "none", l1_max_rows: int = MAX_ROWS, l1_max_bytes: int | None = None,
        pool_max_open: int = 32, l2_refresh_sec: int = int(REFRESH_SECONDS), schema: str | T.StructType | None = None, key: str | None = None,
    ) -> DataFrame:
        """Register a table of all sources and return it.

        ``cache_db`` names the folder of the refreshed copy, ``'none'`` turns it off.
        ``pool_max_open`` is checked and has no effect. ``mode='snapshot'`` copies the
        sources now, and queries read the copy.
        """
        numbers = {"l1_max_rows": l1_max_rows, "pool_max_open": pool_max_open, "l2_refresh_sec": l2_refresh_sec} | ({"l1_max_bytes": l1_max_bytes} if l1_max_bytes is not None else {})
        for k, v in numbers.items():
            if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ValueError(f"{k} must be a whole number over 0, not {v!r}")
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
        if not table:
            raise ValueError("table is required")
        registry = Registry(registry_db) if registry_db is not None else self.registry
        if registry is None:
            raise ValueError("registry_db is required")
        if l1_max_bytes is None:
            l1_max_bytes = max(MAX_BYTES, l1_max_rows * 512) if l1_max_rows > 10_000 else MAX_BYTES
        given = parse_override(schema) if schema is not None else None
        found = given or discover(self.spark, registry.sources(table), table)
        if not registry.sources(table):
            raise FederationError("the registry has no active sources for this table")
        copy = None if cache_db == "none" else RefreshedCopy(self.spark, cache_db, l2_refresh_sec)
        own = Table(name, table, registry, mode, key, given, found, ResultCache(l1_max_rows, l1_max_bytes), copy, Snapshot(self.spark, self._folder(name, "snapshot")) if mode == "snapshot" else None)
        fed = self._federation(own)
        own.warnings = fed.warnings
        if own.snapshot:
            own.snapshot.create(fed)
        with self._lock:
            self._tables[name] = own
        return self.table(name)

    def create_from_args(self, name: str, args: list[str], **options) -> DataFrame:
        """As :meth:`create_federated_table`, from ``key=value`` strings; what has no ``=`` is ignored."""
        given: dict[str, object] = {}
        for arg in args:
            k, eq, v = arg.partition("=")
            if not eq:
                continue
            k, v = k.strip(), v.strip().strip("'\"")
            if k not in _KEYS:
                raise ValueError(f"unknown key {k!r}")
            if k in _INTS:
                if not v.isdigit() or int(v) <= 0:
                    raise ValueError(f"{k} must be a whole number over 0, not {v!r}")
                v = int(v)
            given[k] = v
        return self.create_federated_table(name, **given, **options)

    def open_snapshot(self, name: str, *, table: str, registry: Registry | None = None, key: str | None = None) -> DataFrame:
        """Register a table over a snapshot made before, as it is."""
        snapshot = Snapshot(self.spark, self._folder(name, "snapshot"))
        df = snapshot.open()
        own = Table(name, table, registry or self.registry, "snapshot", key, None, select_visible(df).schema, ResultCache(), None, snapshot)
        with self._lock:
            self._tables[name] = own
        return self.table(name)

    def drop_table(self, name: str) -> None:
        """Forget a table, with its snapshot and its view."""
        with self._lock:
            own = self._get(name)
            del self._tables[name]
        if own.snapshot:
            own.snapshot.drop()
        self.spark.catalog.dropTempView(name)

    def _get(self, name: str) -> Table:
        own = self._tables.get(name)
        if own is None:
            raise FederationError(f"no federated table is called {name!r}")
        return own

    def _federation(self, own: Table) -> Federation:
        """The plan over the sources as they are; built again only if the list or a file has changed."""
        sources = own.registry.sources(own.table)
        places = {s.path: s for s in sources}
        with ThreadPoolExecutor(max(1, min(OPENERS, len(places)))) as pool:
            marks = dict(zip(places, pool.map(lambda s: fingerprint(self.spark, s, own.table), places.values()), strict=True))
        now = sources, tuple(marks.items())
        if own.built is None or own.built[0] != now:
            own.built = now, federate(self.spark, sources, own.table, own.key, own.given, own.schema)
        return own.built[1]

    def table(self, name: str) -> DataFrame:
        """The table as the registry has it now, with its hidden columns."""
        own = self._get(name)
        if own.snapshot:
            return own.snapshot.open()
        fed = self._federation(own)
        own.warnings = fed.warnings
        return fed.df

    def visible(self, name: str) -> DataFrame:
        return select_visible(self.table(name))

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        """Any Spark SQL, in which ``LIKE`` and ``GLOB`` have SQLite's meaning; every federated table is a view by its name, up to date with the registry."""
        text = translate(text)
        with self._lock:
            for name in self._tables:
                self.table(name).createOrReplaceTempView(name)
            return self.spark.sql(text, args=args) if args is not None else self.spark.sql(text)

    # -- queries --

    def lookup(self, name: str, rowid: int) -> DataFrame:
        """The row of a composite row id: one source is read, by its own key. An unknown id gives no rows."""
        own = self._get(name)
        source_id, row = unpack_rowid(rowid)
        aliases = {s.id: s.alias for s in own.registry.sources(own.table)} if own.registry else {}
        df = self.table(name)
        if own.snapshot or source_id not in aliases:
            return df.filter(F.col(ROWID) == F.lit(rowid))
        by = own.key if own.key else ROW_NUMBER
        return df.filter((F.col(SOURCE) == aliases[source_id]) & (F.col(by) == F.lit(row)) & (F.col(ROWID) == F.lit(rowid)))

    def head(self, name: str, n: int) -> DataFrame:
        """The first rows in source order."""
        own = self._get(name)
        return in_source_order(self._enough(own, self.table(name), n)).limit(n)

    @staticmethod
    def _enough(own: Table, df: DataFrame, n: int) -> DataFrame:
        """``df`` without the sources that come after the first ``n`` rows, if the files say how many rows each has."""
        if own.snapshot or not own.registry:
            return df
        for rank, source in enumerate(own.registry.sources(own.table)):
            rows = rows_of(source, own.table)
            if rows is None:
                return df
            n -= rows
            if n <= 0:
                return df.filter(F.col(RANK) <= rank)
        return df

    def _plan(self, df: DataFrame, where, order_by, limit, offset) -> DataFrame:
        if where is not None:
            df = df.filter(F.expr(translate(where)) if isinstance(where, str) else where)
        if order_by:
            by = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
            df = ordered(df, *[b[1:] if isinstance(b, str) and b.startswith("-") else b for b in by], ascending=[not (isinstance(b, str) and b.startswith("-")) for b in by])
        elif limit is not None or offset:  # an order that a limit can rely on
            df = in_source_order(df)
        if offset:
            df = df.offset(offset)
        return df.limit(limit) if limit is not None else df

    def query(self, name: str, where: str | Column | None = None, *, args: list | None = None, source: str | None = None, order_by=None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows through the cache tiers: a kept result, then the refreshed copy if it is fresh, then the sources.

        ``order_by`` takes names, with a leading ``-`` for descending. Scans of several
        sources without condition, order and limit are never kept.
        """
        own = self._get(name)
        if isinstance(where, str) and args is not None:
            where = bind(where, args)
        live = self.table(name)
        if source is not None:
            live = live.filter(F.col(SOURCE) == source)
        if limit is not None and where is None and source is None and not order_by:
            live = self._enough(own, live, limit + offset)
        asked = self._plan(live, where, order_by, limit, offset)
        bounded = where is not None or limit is not None or source is not None or len(own.registry.sources(own.table) if own.registry else ()) <= 1
        terms = [order_by] if isinstance(order_by, str) else list(order_by or ())
        spelled = (where is None or isinstance(where, str)) and all(isinstance(t, str) for t in terms)
        question = (own.registry.sources(own.table) if own.registry else (), where, source, tuple(terms), limit, offset) if spelled else None
        if bounded and (kept := own.cache.get(asked, question)) is not None:
            return self.spark.createDataFrame(kept, asked.schema) if kept.num_rows else self.spark.createDataFrame([], asked.schema)
        best = asked
        if own.copy and own.copy.fresh:
            best = self._plan(own.copy.open(source), where, order_by, limit, offset).select(asked.columns)
        if bounded:
            probe = best.limit(own.cache.max_rows + 1).toArrow()  # what the budget can take, and one row more
            if own.cache.put(asked, probe, question):
                return self.spark.createDataFrame(probe, asked.schema) if probe.num_rows else self.spark.createDataFrame([], asked.schema)
        return best

    def refresh(self, name: str) -> dict[str, str]:
        """Bring the table's copy up to date, now."""
        own = self._get(name)
        if not own.copy:
            raise FederationError(f"{name!r} has no cache_db")
        return own.copy.refresh(own.table, own.registry.sources(own.table), lambda some: federate(self.spark, some, own.table, own.key, own.given, own.schema))

    def copied(self, name: str) -> DataFrame:
        own = self._get(name)
        if not own.copy:
            raise FederationError(f"{name!r} has no cache_db")
        return own.copy.open()

    def scan(self, name: str) -> Scanner:
        own = self._get(name)
        return Scanner(self.spark, own.registry, own.table, own.key)

    # -- aggregates --

    def aggregate_df(self, function: str, name: str, column: str | None = None, where: str | Column | None = None) -> DataFrame:
        """One row, ``value``; ``name`` is that of a federated table or, if none has it, of the table its sources hold."""
        if not name:
            raise FederationError("the aggregate needs a table")
        if function not in aggregates.FUNCTIONS:
            raise FederationError(f"no aggregate {function!r}")
        if name not in self._tables:
            same = [t.name for t in self._tables.values() if t.table == name]
            name = same[-1] if same else name
        df = self.table(name)
        f = aggregates.FUNCTIONS[function]
        return f(df, where) if function == "count" else f(df, column, where)

    def count(self, name: str, where: str | Column | None = None) -> int:
        return self.aggregate_df("count", name, None, where).first()[0]

    def sum(self, name: str, column: str, where: str | Column | None = None) -> float | None:
        return self.aggregate_df("sum", name, column, where).first()[0]

    def avg(self, name: str, column: str, where: str | Column | None = None) -> float | None:
        return self.aggregate_df("avg", name, column, where).first()[0]

    def min(self, name: str, column: str, where: str | Column | None = None):
        return self.aggregate_df("min", name, column, where).first()[0]

    def max(self, name: str, column: str, where: str | Column | None = None):
        return self.aggregate_df("max", name, column, where).first()[0]

    # -- administration --

    def status(self, name: str) -> dict:
        own = self._get(name)
        sources = own.registry.sources(own.table) if own.registry else ()
        return {
            "l1": own.cache.status(),
            "registry": {"sources": len(sources), "last_reload": own.registry.last_reload if own.registry else 0.0},
            "l2_active": int(own.copy is not None),
            "l2": {"last_refresh": own.copy.last_refresh, "fresh": own.copy.fresh} if own.copy else None,
            "parallelism": self.spark.sparkContext.defaultParallelism,
            "mode": own.mode,
            "warnings": list(own.warnings),
        }

    def flush_cache(self, name: str) -> None:
        """Drop kept results; the copy stays."""
        self._get(name).cache.flush()

    def reload_registry(self, name: str) -> None:
        self._get(name).registry.reload(required=True)

    def add_source(self, name: str, path: str, alias: str, **options) -> int:
        """Add to the table's registry; seen after the next reload."""
        return self._get(name).registry.add_source(path, alias, **options)

    def source_errors(self, name: str) -> int:
        """How many sources couldn't be read when the plan was built."""
        row: Row | None = self.table(name).select(ERRORS).first()
        return row[0] if row else len(self._get(name).warnings)

    def ranks(self, name: str) -> DataFrame:
        return self.table(name).select(SOURCE, RANK).distinct()
