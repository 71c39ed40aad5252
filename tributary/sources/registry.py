"""The registry: which sources there are, in which order, and which tables opt out.

It is kept in a small SQLite file (or in memory) that only the driver reads. A
query takes a snapshot of the source list when its plan is built.
"""

from __future__ import annotations

import sqlite3
import threading
import time
from dataclasses import dataclass

from tributary.errors import FederationError

#: Seconds after which the list is read again.
RELOAD_SECONDS = 60.0


@dataclass(frozen=True)
class Source:
    """One place that holds a table of the common schema.

    ``path`` is a file or folder; ``predicate`` restricts it to the rows that
    belong to this source, so that several sources may share a path.
    """

    id: int
    path: str
    alias: str
    active: bool = True
    priority: int = 0
    format: str = ""
    predicate: str = ""
    notes: str = ""


class Registry:
    """Sources and per-table opt-outs; safe for use by several threads."""

    def __init__(self, path: str | None = None, sources_table: str = "sources", overrides_table: str = "table_overrides", reload_seconds: float = RELOAD_SECONDS):
        self.path, self.reload_seconds = path, reload_seconds
        self._sources_table, self._overrides_table = (_quoted(t) for t in (sources_table, overrides_table))
        self._lock = threading.RLock()
        self._memory = None
        if path is None:
            self._memory = sqlite3.connect(":memory:", check_same_thread=False)
            self._create(self._memory)
        self._list: tuple[Source, ...] = ()
        self._off: frozenset[tuple[int, str]] = frozenset()
        self.last_reload = 0.0
        self.reload(required=True)

    @classmethod
    def init(cls, path: str, **options) -> Registry:
        """Make the registry file's tables if they aren't there, and open it."""
        out = cls.__new__(cls)
        out._sources_table, out._overrides_table = (_quoted(options.get(k, d)) for k, d in (("sources_table", "sources"), ("overrides_table", "table_overrides")))
        db = sqlite3.connect(path)
        try:
            out._create(db)
        finally:
            db.close()
        return cls(path, **options)

    def _create(self, db: sqlite3.Connection) -> None:
        db.executescript(
            f"""CREATE TABLE IF NOT EXISTS {self._sources_table} (
                id INTEGER PRIMARY KEY AUTOINCREMENT, alias TEXT UNIQUE NOT NULL, path TEXT NOT NULL, predicate TEXT NOT NULL DEFAULT '',
                format TEXT NOT NULL DEFAULT '', priority INTEGER DEFAULT 0 NOT NULL, active INTEGER DEFAULT 1 NOT NULL, notes TEXT,
                added_at TEXT DEFAULT CURRENT_TIMESTAMP, UNIQUE (path, predicate));
            CREATE TABLE IF NOT EXISTS {self._overrides_table} (
                table_name TEXT NOT NULL, source_id INTEGER NOT NULL, active INTEGER DEFAULT 1 NOT NULL, PRIMARY KEY (table_name, source_id));"""
        )

    def _run(self, sql: str, values: tuple = ()) -> list[tuple]:
        with self._lock:
            db = self._memory or sqlite3.connect(f"file:{self.path}?mode=rw", uri=True)
            try:
                with db:
                    return db.execute(sql, values).fetchall()
            finally:
                if db is not self._memory:
                    db.close()

    def _columns(self, table: str) -> set[str]:
        return {r[1] for r in self._run(f"PRAGMA table_info({table})")}

    def add_source(self, path: str, alias: str, *, active: bool = True, priority: int = 0, format: str = "", predicate: str = "", notes: str = "") -> int:
        """Insert a source and return its id; a path or alias that is there already is an error.

        Tables see it after the next reload.
        """
        if not path or not alias:
            raise FederationError("a source needs a path and an alias")
        values = {"path": path, "alias": alias, "active": int(active), "priority": priority, "format": format, "predicate": predicate, "notes": notes}
        have = self._columns(self._sources_table)
        values = {k: v for k, v in values.items() if k in have}
        try:
            self._run(f"INSERT INTO {self._sources_table} ({', '.join(values)}) VALUES ({', '.join('?' * len(values))})", tuple(values.values()))
        except sqlite3.IntegrityError as e:
            raise FederationError(f"source {alias!r} at {path!r} is in the registry already: {e}") from e
        return self._run(f"SELECT id FROM {self._sources_table} WHERE alias = ?", (alias,))[0][0]

    def set_active(self, alias: str, active: bool) -> None:
        self._run(f"UPDATE {self._sources_table} SET active = ? WHERE alias = ?", (int(active), alias))

    def remove_source(self, alias: str) -> None:
        self._run(f"DELETE FROM {self._sources_table} WHERE alias = ?", (alias,))

    def set_override(self, alias: str, table: str, active: bool) -> None:
        """Whether a source takes part in one table; only ``False`` has an effect."""
        found = self._run(f"SELECT id FROM {self._sources_table} WHERE alias = ?", (alias,))
        if not found:
            raise FederationError(f"no source is called {alias!r}")
        self._run(f"INSERT OR REPLACE INTO {self._overrides_table} (source_id, table_name, active) VALUES (?, ?, ?)", (found[0][0], table, int(active)))

    def reload(self, required: bool = False) -> bool:
        """Read the list again; if that fails the old list stays, unless ``required``."""
        try:
            have = self._columns(self._sources_table)
            if not {"id", "path", "alias"} <= have:
                raise sqlite3.OperationalError(f"no table of sources in {self.path}")
            extra = [c if c in have else f"{d} AS {c}" for c, d in (("active", 1), ("priority", 0), ("format", "''"), ("predicate", "''"), ("notes", "''"))]
            rows = self._run(f"SELECT id, path, alias, {', '.join(extra)} FROM {self._sources_table} WHERE {'active = 1' if 'active' in have else '1'} ORDER BY {'priority, ' if 'priority' in have else ''}id")
            off = self._run(f"SELECT source_id, table_name FROM {self._overrides_table} WHERE active = 0") if self._columns(self._overrides_table) else []
        except sqlite3.Error as e:
            if required:
                raise FederationError(f"the registry can't be read: {e}") from e
            return False
        with self._lock:
            self._list = tuple(Source(r[0], r[1], r[2], bool(r[3]), r[4], r[5] or "", r[6] or "", r[7] or "") for r in rows)
            self._off = frozenset(off)
            self.last_reload = time.time()
        return True

    def sources(self, table: str | None = None) -> tuple[Source, ...]:
        """Active sources by priority, then id, without those that opt out of ``table``."""
        if time.time() - self.last_reload >= self.reload_seconds:
            self.reload()
        with self._lock:
            return tuple(s for s in self._list if (s.id, table) not in self._off)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
