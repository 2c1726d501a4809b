"""What the corpus operators share: the shared folder, written tables, row keys and checked broadcasts.

Lineage is cut by tables written to the folder that the cluster names in ``spark.checkpoint.dir``; they
survive lost executors, which cached or locally checkpointed blocks do not.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` takes it.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rows up to which a table is broadcast, after it was counted. Beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only if it is unset, and then only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


class Written:
    """A table in the shared folder: ``.df`` reads it, ``drop()`` deletes it once nothing needs it."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, tag)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; results that read it are gone then."""
    remove(spark, f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished steps, which hold disk until a collection runs."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to hold at most ``rows``; else as it is.

    ``df`` should read a written table, since it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(df: DataFrame) -> list[Column]:
    """128 bits over all columns, as two longs: equal for rows that agree in every column."""
    # maps have no hash: a column that holds one anywhere counts as its JSON
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    return [F.xxhash64(*cols).alias("key_a"), F.xxhash64(F.lit("b"), *cols).alias("key_b")]


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row`` beside the row key, so that no column name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *row_key(df))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once per Python worker process and kept over its tasks."""
    held = sys.modules.setdefault("quire_worker_state", types.ModuleType("quire_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Returns freed memory of this Python worker to the system, since workers live on beside later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, fn: Callable, schema, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` that gives its memory back at the end of a task and, with ``rows``, sees so many rows at once."""

    def run(it):
        parts = it if rows is None else (b.slice(k, rows) for b in it for k in range(0, b.num_rows, rows))
        try:
            yield from fn(parts)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def whole_groups(it, key: str, names: tuple[str, ...], rows: int = 250_000):
    """Columns ``key`` and ``names`` as arrays, some whole groups of equal keys at a time; the rows come sorted by key.

    What is held is ``rows`` rows, or one group if that is larger.
    """
    import numpy as np

    held: list[tuple] = []
    size = 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(tuple(np.asarray(b.column(c)) for c in (key, *names)))
        size += b.num_rows
        last = held[-1][0]
        if size < rows or (last[0] == last[-1] and held[0][0][0] == last[0]):
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        stop = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1
        yield [c[:stop] for c in cols]
        held, size = [tuple(c[stop:].copy() for c in cols)], len(cols[0]) - stop
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


class Memo:
    """A table in two generations of bounded size: what is asked for again outlives what is not.

    ``limit`` bounds the bytes of a generation, by the length of the keys and what each entry takes besides.
    Keys of over ``LONG`` characters are never kept: they seldom come again.
    """

    LONG, ENTRY = 64, 160

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those that are in neither generation; the others are moved to the new one."""
        if self.size > self.limit:
            self.new, self.old, self.size = {}, self.new, 0
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if (found := old.get(k)) is not None:
                    self.put(k, found)
                else:
                    out.append(k)
        return out

    def put(self, key: str, value) -> None:
        self.new[key] = value
        self.size += 2 * len(key) + self.ENTRY
