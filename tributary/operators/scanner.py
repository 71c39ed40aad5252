"""Bulk scans: rows of the sources one after another, or in parallel, without SQL around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tributary.errors import FederationError
from tributary.functions.predicates import bind, translate
from tributary.operators.federate import RANK, SOURCE, SOURCE_ID, federate, in_source_order
from tributary.sources.readers import ROW_NUMBER
from tributary.sources.registry import Registry

MAX_BINDS = 64


class Scanner:
    """A forward scan of one table over all sources that have it.

    A filter with ``?`` marks and their values may be set before the first row is
    read. Rows come by source, then in its order. Values of the current row are read
    by column place; out of a row they are 0, 0.0 or None.
    """

    def __init__(self, spark: SparkSession, registry: Registry, table: str, key: str | None = None):
        self._fed = federate(spark, registry.sources(table), table, key=key, lenient=True)
        self._where: str | None = None
        self._binds: dict[int, object] = {}
        self._rows: Iterator[Row] | None = None
        self._row: Row | None = None
        self._used = False

    @property
    def columns(self) -> list[str]:
        return self._fed.schema.names

    def filter(self, where: str) -> Scanner:
        """Set the condition; values bound before are forgotten."""
        self._before_start()
        self._where, self._binds = where, {}
        return self

    def bind(self, place: int, value: object) -> Scanner:
        """Bind the value of the ``place``-th mark, from 1."""
        self._before_start()
        if not 1 <= place <= MAX_BINDS:
            raise ValueError(f"marks are numbered 1 to {MAX_BINDS}")
        if self._where is None:
            raise FederationError("set a filter before binding values")
        self._binds[place] = value
        return self

    def _before_start(self) -> None:
        if self._used:
            raise FederationError("the scan has begun")

    def to_df(self) -> DataFrame:
        """The scan as a DataFrame, unordered, with the source columns."""
        df = self._fed.df
        if self._where is not None:
            values = [self._binds.get(i) for i in range(1, max(self._binds, default=0) + 1)]
            df = df.filter(F.expr(translate(bind(self._where, values))))
        return df

    def next(self) -> bool:
        """Go to the next row; whether there is one."""
        if self._rows is None:
            if self._used:
                return False
            self._used = True
            self._rows = self._by_source()
        self._row = next(self._rows, None)
        return self._row is not None

    def _by_source(self) -> Iterator[Row]:
        """One source after another, each sorted by itself: the first rows come without the others being read."""
        df = self.to_df()
        for rank in range(len(self._fed.sources)):
            yield from in_source_order(df.filter(F.col(RANK) == rank)).toLocalIterator(prefetchPartitions=True)

    def value(self, place: int):
        return None if self._row is None or not 0 <= place < len(self.columns) else self._row[place]

    def int64(self, place: int) -> int:
        v = self.value(place)
        try:
            return 0 if v is None else int(v)
        except (TypeError, ValueError):
            return 0

    def double(self, place: int) -> float:
        v = self.value(place)
        try:
            return 0.0 if v is None else float(v)
        except (TypeError, ValueError):
            return 0.0

    def text(self, place: int) -> str | None:
        v = self.value(place)
        return v if v is None or isinstance(v, str) else str(v)

    def blob(self, place: int) -> bytes | None:
        v = self.value(place)
        return v if v is None or isinstance(v, (bytes, bytearray)) else str(v).encode()

    def is_null(self, place: int) -> bool:
        return self.value(place) is None

    @property
    def rowid(self) -> int:
        """The row's number in its own source."""
        return 0 if self._row is None or self._row[ROW_NUMBER] is None else self._row[ROW_NUMBER]

    @property
    def source_alias(self) -> str | None:
        return None if self._row is None else self._row[SOURCE]

    @property
    def source_id(self) -> int:
        return 0 if self._row is None else self._row[SOURCE_ID]

    def each(self, call: Callable[[Scanner], int | None]) -> int:
        """Call for every row; stop at the first result that isn't 0 or None and return it."""
        while self.next():
            if got := call(self):
                return got
        return 0

    def parallel(self, call: Callable[[dict], int | None], batches: bool = False) -> int:
        """Call for every row in the tasks, wherever they are read; a result other than 0 or None ends that task.

        With ``batches``, the call gets an Arrow batch at a time. Tasks read parts of
        sources, and nothing is moved. Returns how many rows were handed over. The
        scanner is at its end afterwards.
        """
        self._before_start()
        self._used = True
        names = [*self.columns, SOURCE, SOURCE_ID, ROW_NUMBER]

        def run(it):
            import pyarrow as pa

            done, stopped = 0, False
            for batch in it:
                for part in [] if stopped else [batch] if batches else batch.to_pylist():
                    done += part.num_rows if batches else 1
                    if call(part):
                        stopped = True
                        break
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

        own = self.to_df().select(*(f"`{c.replace('`', '``')}`" for c in names))
        return own.mapInArrow(run, "done bigint").agg(F.coalesce(F.sum("done"), F.lit(0))).first()[0]

    def close(self) -> None:
        self._rows, self._row, self._used = None, None, True
