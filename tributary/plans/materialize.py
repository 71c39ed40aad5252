"""Copies of a federated table as Parquet, a folder a source: snapshots and the second cache tier."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.errors import FederationError
from tributary.operators.federate import ERRORS, SOURCE, Federation
from tributary.sources.files import Files, join
from tributary.sources.readers import fingerprint
from tributary.sources.registry import Source

REFRESH_SECONDS = 300.0
#: Sources that are copied at a time.
COPIERS = 8


class Snapshot:
    """A copy of all sources at one time; later openings use it as it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    @property
    def exists(self) -> bool:
        return self.files.exists(join(self.path, "_SUCCESS"))

    def create(self, fed: Federation) -> None:
        """Copy the sources that can be read, beside what is there, and put it in place when it is whole."""
        new = f"{self.path}.{uuid.uuid4().hex}"
        fed.df.drop(ERRORS).write.partitionBy(SOURCE).parquet(new)
        self.files.write(join(new, "_schema.json"), fed.df.drop(ERRORS).schema.json())
        self.drop()
        self.files.rename(new, self.path)

    def open(self) -> DataFrame:
        """The copy's rows; predicates on the source prune its folders."""
        if not self.exists:
            raise FederationError(f"no snapshot at {self.path}")
        schema = T.StructType.fromJson(json.loads(self.files.read(join(self.path, "_schema.json"))))
        df = self.spark.read.schema(schema).parquet(self.path)
        return df.withColumn(ERRORS, F.lit(0))

    def drop(self) -> None:
        self.files.delete(self.path)


class RefreshedCopy:
    """A copy that is brought up to date source by source.

    A refresh rewrites the sources whose files changed (by time and size), keeps
    the old rows of those whose files are gone, and drops those that are no longer
    registered. Each source's rows are one folder, replaced whole; a listing that is
    swapped in last says which folders count, so readers see old or new, not a mix.
    """

    def __init__(self, spark: SparkSession, path: str, refresh_seconds: float = REFRESH_SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.refresh_seconds, self._clock = spark, path, refresh_seconds, clock
        self.files, self._listing = Files(spark), join(path, "listing.json")

    def _read(self) -> dict:
        text = self.files.read(self._listing)
        return json.loads(text) if text else {"refreshed": 0.0, "schema": None, "sources": {}}

    @property
    def last_refresh(self) -> float:
        return self._read()["refreshed"]

    @property
    def fresh(self) -> bool:
        last = self.last_refresh
        return last > 0 and self._clock() - last < self.refresh_seconds

    def refresh(self, table: str, sources: tuple[Source, ...], federate: Callable[[tuple[Source, ...]], Federation]) -> dict[str, str]:
        """What was done with each source: copied, kept, stale (its files are gone) or dropped."""
        now, done = self._read(), {}
        held, files = now["sources"], {}

        def bring(s: Source) -> tuple[str, dict | None, str | None]:
            """What was done, the source's entry, and the schema of a copy that was made."""
            print_ = fingerprint(self.spark, s, table)
            mark = None if print_ is None else [*print_, s.path, s.predicate, s.id]
            old = held.get(s.alias)
            if mark is not None and old and old["mark"] == mark:
                return "kept", old, None
            if mark is not None and not (fed := federate((s,))).failed:
                folder = f"{quote(s.alias, safe='')}-{uuid.uuid4().hex}"
                fed.df.drop(ERRORS).write.parquet(join(self.path, folder))
                return "copied", {"folder": folder, "mark": mark}, fed.df.drop(ERRORS).schema.json()
            return ("stale", old, None) if old else ("missing", None, None)

        with ThreadPoolExecutor(max(1, min(COPIERS, len(sources)))) as pool:
            for s, (what, entry, schema) in zip(sources, pool.map(bring, sources), strict=True):
                done[s.alias] = what
                if entry:
                    files[s.alias] = entry
                now["schema"] = schema or now["schema"]
        done |= dict.fromkeys(held.keys() - {s.alias for s in sources}, "dropped")
        self.files.write(self._listing, json.dumps({"refreshed": self._clock(), "schema": now["schema"], "sources": files}))
        for alias, entry in held.items():
            if files.get(alias, {}).get("folder") != entry["folder"]:
                self.files.delete(join(self.path, entry["folder"]))
        return done

    def open(self, source: str | None = None) -> DataFrame:
        """The copied rows, of one source if it is named."""
        now = self._read()
        if now["schema"] is None:
            raise FederationError(f"nothing has been copied to {self.path}")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        folders = [join(self.path, e["folder"]) for a, e in now["sources"].items() if source in (None, a)]
        df = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return df.withColumn(ERRORS, F.lit(0))

    def drop(self) -> None:
        self.files.delete(self.path)
