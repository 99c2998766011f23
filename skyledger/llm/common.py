"""What the training-data operators share: tables, bounded batches and partition counts."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PART_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import this package; elsewhere ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_count(n_bytes: int, part_bytes: int = PART_BYTES) -> int:
    """Partitions of about ``part_bytes`` each; grows with the data and has no upper cap."""
    return max(1, math.ceil(n_bytes / part_bytes))


def n_words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(batches: Iterator[pa.RecordBatch], text: str, max_chars: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that the texts of a slice hold about ``max_chars``; null texts become empty.

    Only the texts of one slice are Python strings at a time.
    """
    for batch in batches:
        texts = batch.column(text)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0), dtype="int64"))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(int(np.searchsorted(ends, before + max_chars)) + 1, batch.num_rows)
            yield batch.slice(start, end - start), [t or "" for t in texts.slice(start, end - start).to_pylist()]
            start = end


@contextlib.contextmanager
def text_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Actions inside hand tasks Arrow batches of about ``size``: 10,000 whole texts, the usual batch, may be any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and the next operator needs the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only this C library keeps what was freed


def tidy(task: Callable) -> Callable:
    """``task``, which maps Arrow batches, and then ``give_back``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run
