"""Pieces shared by the text operators: table access, Arrow batches, durable intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.held import materialise, shared_folder  # noqa: F401

#: The characters that separate words: space, tab, \n, \v, \f and \r. ``bytes.split()`` cuts at
#: exactly these, so words are taken from UTF-8 bytes, never with ``str.split``.
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(written: DataFrame) -> None:
    """Deletes the files of a table from ``materialise`` that nothing will read again."""
    spark = written.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` that gives a task's freed Arrow buffers back, as Spark's workers live on."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


_held: dict = {}


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What ``make`` makes, kept by this worker for later tasks, in place of what it kept for
    another operator: a worker serves many stages, and holds the caches of one only."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class BoundedCache(dict):
    """A dict that is emptied when it holds ``limit`` entries, so that a worker's memory stays bounded."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
