"""Aggregates over a federated table: partial in each scan task, then combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.errors import FederationError
from tributary.functions.predicates import translate


def _filtered(df: DataFrame, where: str | Column | None) -> DataFrame:
    if where is None:
        return df
    return df.filter(F.expr(translate(where)) if isinstance(where, str) else where)


def _column(df: DataFrame, column: str | None) -> tuple[Column, bool]:
    if not column:
        raise FederationError("the aggregate needs a column")
    if column not in df.columns:
        raise FederationError(f"no column {column!r}")
    return F.col("`" + column.replace("`", "``") + "`"), isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def count(df: DataFrame, where: str | Column | None = None) -> DataFrame:
    """One row ``value``: the number of rows, 0 of none."""
    return _filtered(df, where).agg(F.count(F.lit(1)).alias("value"))


def total(df: DataFrame, column: str, where: str | Column | None = None) -> DataFrame:
    """The sum as a double; null of no values."""
    return _filtered(df, where).agg(F.sum(_column(df, column)[0].try_cast("double")).alias("value"))


def average(df: DataFrame, column: str, where: str | Column | None = None) -> DataFrame:
    """The mean as a double; null of no values."""
    return _filtered(df, where).agg(F.avg(_column(df, column)[0].try_cast("double")).alias("value"))


def _extreme(df: DataFrame, column: str, where: str | Column | None, f) -> DataFrame:
    c, numeric = _column(df, column)
    return _filtered(df, where).agg(f(c.cast("double") if numeric else c).alias("value"))


def least(df: DataFrame, column: str, where: str | Column | None = None) -> DataFrame:
    """The least value: a double of numbers, else of the column's own type."""
    return _extreme(df, column, where, F.min)


def greatest(df: DataFrame, column: str, where: str | Column | None = None) -> DataFrame:
    """The greatest value, typed as :func:`least`'s."""
    return _extreme(df, column, where, F.max)


FUNCTIONS = {"count": count, "sum": total, "avg": average, "min": least, "max": greatest}
