"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftlink.sources.shared import removed, written  # noqa: F401 (for the operators)

#: Bytes that an Arrow batch of a text operator may have.
BATCH_BYTES = 8 << 20
#: Rows of a key from which it is joined by broadcast, and rows that a broadcast list has at most.
HOT_ROWS, BROADCAST_ROWS = 256, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named input table, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are held to BATCH_BYTES, for as long as the session lives: ten thousand long texts in one batch would fill a worker's memory, and the setting is read when a query runs. A smaller limit stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if bytes_of(conf.get(key)) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def bytes_of(setting: str) -> int:
    """A size with or without a unit; a limit that is not positive is none."""
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([a-z]*)\s*", setting.lower()).groups()
    size = int(number) << 10 * " kmgtp".index(unit[:1] if unit[:1] in set("kmgtp") else " ")
    return size if size > 0 else 1 << 62


def need(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns only: other columns can't clash with what an operator adds."""
    small_batches(df)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def released() -> None:
    """Gives memory that is free back to the machine, where the C library can: workers live as long as executors."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one slice holds about ``most`` bytes of text (or one longer row): it bounds a worker's memory."""
    for batch in batches:
        n, start, size = batch.num_rows, 0, 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, length in enumerate(lengths):
            size += length or 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < n:
            yield batch.slice(start)
    released()


def hot_join(rows: DataFrame, side: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with ``side``, which has one row a key and in ``size`` how many of ``rows`` have it (written before, since it is read three times).

    Hot keys are joined by broadcast, so that no task gets all rows of one; fewer than BROADCAST_ROWS keys can be
    hot, because the limit rises with the number of rows. The others are joined by a shuffle.
    """
    total = side.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    limit = max(HOT_ROWS, -(-int(total) // BROADCAST_ROWS))
    hot = F.broadcast(side.filter(F.col(size) > limit))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(side.filter(F.col(size) <= limit), keys, how)
    return rows.join(hot, keys).unionByName(rest)


Query = Callable[[SparkSession, str], DataFrame]
