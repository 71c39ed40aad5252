"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to Python at a time, where the session leaves Spark's default: ten thousand texts are too many to hold twice over.
BATCH_ROWS, SPARKS_BATCH_ROWS = 1000, "10000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have texts handed over in smaller batches, unless the session says how many; results don't depend on it."""
    if spark.conf.get(_BATCH, SPARKS_BATCH_ROWS) == SPARKS_BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only a session on one machine without that setting, as in tests, gets a folder of
    its own; on a cluster its absence is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Folders that :func:`cut` has written and nothing has deleted yet, in order.
_WRITTEN: list[str] = []


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost no recomputation."""
    path = f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of tables made by :func:`cut` that no later step reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tributary-" in path:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN[:] = [p for p in _WRITTEN if p.rsplit("/", 1)[1] != path.rsplit("/", 1)[1]]


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame that ``make`` gives, written; the tables that were written on the way are deleted."""
    before = set(_WRITTEN)
    out = cut(spark, make(), name)
    for path in [p for p in _WRITTEN if p not in before][:-1]:
        _delete(spark, path)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever its case."""
    return apart(df.columns, *names)


def apart(have: Iterable[str], *names: str) -> list[str]:
    """The names, with a leading ``_`` where one is had already, whatever its case."""
    taken = {c.lower() for c in have}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: str, id_column: str, text_column: str) -> DataFrame:
    """``run`` over ids and texts; its ``columns`` (DDL) follow the id's, with a leading ``_`` where one has the id column's name."""
    own = df.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).cast("string").alias("text"))
    fields = T.StructType.fromDDL(columns).fields
    out = own.mapInArrow(run, T.StructType([own.schema["id"], *fields]))
    return out.toDF(id_column, *apart([id_column], *(f.name for f in fields)))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, offsets of the rows, and which rows are null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_string())
    valid = np.ones(len(wide), bool) if not wide.null_count else wide.is_valid().to_numpy(zero_copy_only=False)
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), ~valid
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = wide.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], ~valid


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range by itself."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def lists(values: np.ndarray, counts: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of ``counts`` values a row; null rows must count none."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if offsets[-1] > 2**31 - 1:
        raise ValueError("a batch of rows holds over 2^31 values")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind), mask=pa.array(null) if null.any() else None)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]`` of all ``i``, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system, which a worker that waits for its next task doesn't need."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def batches(it: Iterable[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for n, batch in enumerate(it):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        if n % 3 == 2:
            release()
    release()

