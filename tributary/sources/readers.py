"""Opening sources: which files hold a table, and how Spark reads them."""

from __future__ import annotations

import json
import os
import sqlite3
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tributary.errors import FederationError
from tributary.sources.files import Files
from tributary.sources.registry import Source
from tributary.sources.schema import affinity

FORMATS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json", ".csv": "csv", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite"}
#: Key column that stands for a row's own number in its source.
ROW_NUMBER = "_source_rowid"
#: Places that the driver opens at a time.
OPENERS = 16
_FILE_BITS, _ROW_BITS = 12, 28


class SqliteSource(DataSource):
    """One table of one SQLite file, read only. Options: path, table."""

    @classmethod
    def name(cls) -> str:
        return "tributary_sqlite"

    def schema(self) -> T.StructType:
        return sqlite_schema(self.options["path"], self.options["table"]).add(ROW_NUMBER, T.LongType())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    """Row number ranges of the table are partitions; cells of another type than the column's are cast or null.

    Conditions stay with Spark: its pushdown to Python sources keeps those of one query
    for the next over the same relation. A file that is lost or broken by the time it is
    read gives no (more) rows.
    """

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.rows = int(options.get("partitionrows", 1_000_000))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        try:
            db = self._open()
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_column(self.table)}").fetchone()
            finally:
                db.close()
        except sqlite3.Error:
            low = None
        if low is None:
            return [InputPartition((0, -1))]
        return [InputPartition((a, min(a + self.rows - 1, high))) for a in range(low, high + 1, self.rows)]

    def read(self, partition: InputPartition):
        low, high = partition.value
        names = ", ".join("rowid" if f.name == ROW_NUMBER else _column(f.name) for f in self.schema)
        casts = [_cell(f.dataType) for f in self.schema]
        try:
            db = self._open()
            try:
                for row in db.execute(f"SELECT {names} FROM {_column(self.table)} WHERE rowid BETWEEN ? AND ?", (low, high)):
                    yield tuple(None if v is None else c(v) for c, v in zip(casts, row, strict=True))
            finally:
                db.close()
        except sqlite3.Error:
            return


def _column(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _cell(kind: T.DataType):
    def number(to):
        def cast(v):
            try:
                return to(v)
            except (TypeError, ValueError):
                return None

        return cast

    if isinstance(kind, T.LongType):
        return number(int)
    if isinstance(kind, T.DoubleType):
        return number(float)
    if isinstance(kind, T.BinaryType):
        return lambda v: v if isinstance(v, bytes) else str(v).encode()
    return lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def sqlite_schema(path: str, table: str) -> T.StructType:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        rows = db.execute(f'PRAGMA table_info("{table}")').fetchall()
    finally:
        db.close()
    return T.StructType([T.StructField(r[1], affinity(r[2]), True, {"declared": r[2], "pk": bool(r[5]), "notnull": bool(r[3])}) for r in rows])


def file_format(source: Source, path: str) -> str:
    return source.format or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "parquet")


def locate(source: Source, table: str) -> str:
    """The file or folder of the table: the source's path, or what it holds under the table's name."""
    path = source.path
    if os.path.isdir(path) and not path.rstrip("/").endswith((".parquet", ".orc", ".json", ".csv")):
        for end in ("", *FORMATS):
            if os.path.exists(at := os.path.join(path, table + end)):
                return at
    return path


def fingerprint(spark: SparkSession, source: Source, table: str) -> tuple[int, int] | None:
    """(newest change, bytes) of the source's files; None if they aren't there."""
    return Files(spark).mark(locate(source, table))


def open_sources(spark: SparkSession, sources: tuple[Source, ...], table: str, schema: T.StructType | None = None, row_numbers: bool = False, whole: bool = False) -> list[DataFrame | FederationError]:
    """Every source's rows, or why it can't be read. Each place is opened once, several at a time.

    ``whole`` leaves the sources' predicates to the caller, who gets one frame a place.
    """
    places = {(locate(s, table), s.format): s for s in reversed(sources)}

    def opened(item):
        try:
            return item[0], _open(spark, item[1], table, schema, row_numbers)
        except FederationError as e:
            return item[0], e

    with ThreadPoolExecutor(max(1, min(OPENERS, len(places)))) as pool:
        bases = dict(pool.map(opened, places.items()))
    out: list[DataFrame | FederationError] = []
    for s in sources:
        base = bases[locate(s, table), s.format]
        try:
            out.append(base.filter(F.expr(s.predicate)) if s.predicate and not whole and isinstance(base, DataFrame) else base)
        except Exception as e:
            out.append(FederationError(f"source {s.alias!r}: {str(e).splitlines()[0]}"))
    return out


def open_source(spark: SparkSession, source: Source, table: str, schema: T.StructType | None = None, row_numbers: bool = False) -> DataFrame:
    """The source's rows with its own columns, and ``_source_rowid`` if asked for; any failure raises FederationError."""
    got = open_sources(spark, (source,), table, schema, row_numbers)[0]
    if isinstance(got, FederationError):
        raise got
    return got


def _open(spark: SparkSession, source: Source, table: str, schema: T.StructType | None, row_numbers: bool) -> DataFrame:
    path = locate(source, table)
    kind = file_format(source, path)
    try:
        if kind == "sqlite":
            if not os.path.exists(path):
                raise FederationError(f"no file at {path}")
            own = sqlite_schema(path, table)
            if not own.fields:
                raise FederationError(f"no table {table!r} in {path}")
            spark.dataSource.register(SqliteSource)
            df = spark.read.format("tributary_sqlite").option("path", path).option("table", table).load()
            if schema is not None and schema.names != own.names:
                df = df.select(*[n for n in schema.names if n in own.names], ROW_NUMBER)
        else:
            # A source that is lost, or broken, by the time it is read is left out, as one that can't be opened is.
            lenient = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}
            reader = spark.read.options(**lenient).schema(schema) if schema is not None and kind in ("csv", "json") else spark.read.options(**lenient)
            if kind == "csv":
                reader = reader.option("header", True) if schema is not None else reader.option("header", True).option("inferSchema", True)
            if kind == "parquet" and (known := _footer(path)) is not None:
                reader = reader.schema(known)
            df = reader.format(kind).load(path)
            if row_numbers:
                if kind != "parquet":
                    raise FederationError(f"rows of {kind} files have no stable number; name a key column")
                df = df.withColumn(ROW_NUMBER, _row_number(df))
        return df if row_numbers else df.drop(ROW_NUMBER)
    except FederationError:
        raise
    except Exception as e:
        raise FederationError(f"source {source.alias!r} at {path}: {str(e).splitlines()[0]}") from e


_PLAIN = {"string": T.StringType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "date32[day]": T.DateType(), "int16": T.ShortType(), "int8": T.ByteType()}


def _footer(path: str) -> T.StructType | None:
    """The schema of a local file, or folder of files, from a footer: Spark would run a job for it. None where Spark must say."""
    path = path.removeprefix("file://")
    if "://" in path:
        return None
    if os.path.isdir(path):
        names = sorted(n for n in os.listdir(path) if n[0] not in "_.")
        if not names or any("=" in n for n in names):
            return None
        path = os.path.join(path, names[0])
    if not os.path.isfile(path):
        return None
    own = pq.read_schema(path)
    if own.metadata and (written := own.metadata.get(b"org.apache.spark.sql.parquet.row.metadata")):
        return T.StructType.fromJson(json.loads(written))
    kinds = [_PLAIN.get(str(f.type)) for f in own]
    return None if None in kinds else T.StructType([T.StructField(f.name, k) for f, k in zip(own, kinds, strict=True)])


def rows_of(source: Source, table: str) -> int | None:
    """How many rows a local Parquet source has, by its footers; None where they can't say."""
    path = locate(source, table).removeprefix("file://")
    if source.predicate or "://" in path or file_format(source, path) != "parquet":
        return None
    files = [path]
    if os.path.isdir(path):
        names = [n for n in os.listdir(path) if n[0] not in "_."]
        files = [os.path.join(path, n) for n in names]
    if not files or not all(os.path.isfile(f) for f in files):
        return None
    try:
        return sum(pq.read_metadata(f).num_rows for f in files)
    except (OSError, pa.ArrowInvalid):
        return None


def _row_number(df: DataFrame):
    files = sorted(df.inputFiles())
    row = F.col("_metadata.row_index")
    if len(files) <= 1:
        return row
    if len({f.rsplit("/", 1)[1] for f in files}) < len(files):
        raise FederationError("two files of one name can't number rows; name a key column")
    # Rows beyond what a file's share of the number holds are an error, not another file's rows.
    row = F.when(row < (1 << _ROW_BITS), row).otherwise(F.raise_error(F.lit("a file has too many rows to number them by; name a key column")))
    if len(files) >= 1 << _FILE_BITS:
        raise FederationError(f"{len(files)} files are too many to number rows by; name a key column")
    place = F.lit(None).cast("bigint")
    names = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f.rsplit("/", 1)[1]), F.lit(i).cast("bigint"))])
    place = names[F.col("_metadata.file_name")]
    return F.shiftleft(place, _ROW_BITS).bitwiseOR(row)
