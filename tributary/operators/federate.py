"""The federated scan: a union of the sources, each row tagged with where it comes from."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.errors import FederationError
from tributary.functions.predicates import literal
from tributary.sources.readers import ROW_NUMBER, open_source, open_sources
from tributary.sources.registry import Source
from tributary.sources.schema import check_match, parse_override

SOURCE, ERRORS, ROWID, SOURCE_ID, RANK = "_source_db", "_source_errors", "_rowid", "_source_id", "_source_rank"
#: Columns that queries may use but ``select_visible`` leaves out.
HIDDEN = (SOURCE, ERRORS, ROWID, SOURCE_ID, RANK, ROW_NUMBER)
ROW_BITS = 40
ROW_MASK = (1 << ROW_BITS) - 1


def pack_rowid(source_id: int, row: int) -> int:
    return (source_id << ROW_BITS) | (row & ROW_MASK)


def unpack_rowid(rowid: int) -> tuple[int, int]:
    return rowid >> ROW_BITS, rowid & ROW_MASK


@dataclass
class Federation:
    """A federated table as it stands: the rows, what couldn't be read, and the schema."""

    df: DataFrame
    schema: T.StructType
    sources: tuple[Source, ...]
    failed: tuple[Source, ...] = ()
    warnings: list[str] = field(default_factory=list)


def discover(spark: SparkSession, sources: tuple[Source, ...], table: str, lenient: bool = False) -> T.StructType:
    """The schema of the first source; with ``lenient``, of the first that has the table."""
    if not sources:
        raise FederationError("the registry has no active sources for this table")
    last: FederationError | None = None
    for source in sources:
        try:
            found = open_source(spark, source, table).schema
            if not found.fields:
                raise FederationError(f"table {table!r} has no columns in source {source.alias!r}")
            return found
        except FederationError as e:
            if not lenient:
                raise
            last = e
    raise FederationError(f"no source has table {table!r}: {last}")


def federate(spark: SparkSession, sources: tuple[Source, ...], table: str, key: str | None = None, schema: str | T.StructType | None = None, first_schema: T.StructType | None = None, lenient: bool = False) -> Federation:
    """Union of the sources in their order.

    Each branch carries its source as literals, so that Catalyst drops branches by
    any predicate on them and pushes the others down to the files. Unreadable
    sources are left out and counted in ``_source_errors``. ``key`` names an integer
    column that numbers a source's rows; without it the files' row numbers do.
    """
    given = parse_override(schema) if schema is not None else None
    expected = given or first_schema or discover(spark, sources, table, lenient)
    opened: list[tuple[int, Source, DataFrame]] = []
    failed, warnings = [], []
    valid: dict[int, set[str]] = {}
    for rank, (source, own) in enumerate(zip(sources, open_sources(spark, sources, table, given, row_numbers=key is None, whole=True), strict=True)):
        if isinstance(own, FederationError):
            failed.append(source)
            warnings.append(str(own))
            continue
        visible = T.StructType([f for f in own.schema if f.name != ROW_NUMBER])
        if source.predicate and (wrong := _invalid(own, source, valid)):
            failed.append(source)
            warnings.append(wrong)
            continue
        if given is None:
            if lenient and visible.names != expected.names:
                failed.append(source)
                warnings.append(f"source {source.alias!r} has other columns")
                continue
            check_match(expected, visible, source.path, source.alias)
        elif missing := [n for n in expected.names if n not in visible.names]:
            failed.append(source)
            warnings.append(f"source {source.alias!r} lacks columns {missing}")
            continue
        opened.append((rank, source, own))
    if not opened:
        hidden = T.StructType([T.StructField(SOURCE, T.StringType()), T.StructField(ERRORS, T.IntegerType()), T.StructField(ROWID, T.LongType()), T.StructField(SOURCE_ID, T.LongType()), T.StructField(RANK, T.IntegerType()), T.StructField(ROW_NUMBER, T.LongType())])
        return Federation(spark.createDataFrame([], T.StructType([*expected.fields, *hidden.fields])), expected, sources, tuple(failed), warnings)
    return Federation(union(spark, opened, expected, key, len(failed)), expected, sources, tuple(failed), warnings)


def union(spark: SparkSession, opened: list[tuple[int, Source, DataFrame]], expected: T.StructType, key: str | None, errors: int) -> DataFrame:
    """All branches as one SQL text, which Spark analyses once: built one by one they would cost some fifty milliseconds each.

    Places that several sources share are one view each; the views go when the plan is made.
    """
    views: dict[int, str] = {}
    run = uuid.uuid4().hex
    branches = []
    for rank, source, own in opened:
        if id(own) not in views:
            views[id(own)] = f"tributary_{run}_{len(views)}"
            own.createOrReplaceTempView(views[id(own)])
        kinds = {f.name: f.dataType for f in own.schema}
        columns = [_quoted(f.name) if kinds[f.name] == f.dataType else f"try_cast({_quoted(f.name)} AS {f.dataType.simpleString()}) AS {_quoted(f.name)}" for f in expected]
        row = f"CAST({_quoted(key or ROW_NUMBER)} AS BIGINT)"
        rowid = f"shiftleft({literal(source.id)}, {ROW_BITS}) | ({row} & {literal(ROW_MASK)})"
        hidden = (f"{literal(source.alias)} AS {SOURCE}", f"{errors} AS {ERRORS}", f"{rowid} AS {ROWID}", f"{literal(source.id)} AS {SOURCE_ID}", f"{rank} AS {RANK}", f"{row} AS {ROW_NUMBER}")
        where = f" WHERE {source.predicate}" if source.predicate else ""
        branches.append(f"SELECT {', '.join((*columns, *hidden))} FROM {views[id(own)]}{where}")
    try:
        return spark.sql("\nUNION ALL\n".join(branches))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _invalid(own: DataFrame, source: Source, valid: dict[int, set[str]]) -> str | None:
    """Why the source's predicate can't be used; predicates of one form are tried once a place."""
    form = re.sub(r"\d+|'[^']*'", "?", source.predicate)
    if form in valid.setdefault(id(own), set()):
        return None
    try:
        own.filter(F.expr(source.predicate))
    except Exception as e:
        return f"source {source.alias!r}: {str(e).splitlines()[0]}"
    valid[id(own)].add(form)
    return None


def select_visible(df: DataFrame) -> DataFrame:
    """The real columns only."""
    return df.select(*(_quoted(c) for c in df.columns if c not in HIDDEN))


def in_source_order(df: DataFrame) -> DataFrame:
    """Rows by source, then by their place in it: the order of an unordered scan."""
    return df.orderBy(RANK, ROW_NUMBER)


def ordered(df: DataFrame, *by, ascending: bool | list[bool] = True) -> DataFrame:
    """Sorted, ties in source order."""
    up = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    columns = [(F.col(c) if isinstance(c, str) else c) for c in by]
    return df.orderBy(*(c.asc() if a else c.desc() for c, a in zip(columns, up, strict=True)), RANK, ROW_NUMBER)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
