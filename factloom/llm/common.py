"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one Arrow batch may hold. Rows differ in size by a factor
# of thousands, so batches are bounded by bytes and not by rows alone.
BATCH_BYTES = 4 << 20
# Settings of the allocators of Python workers: Arrow by the system's, few arenas, freed ends returned at once.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name.

    Other columns of the input, also those whose names differ only by case or
    equal a helper column of an operator, cannot interfere afterwards.
    """
    places = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(places, names, strict=True)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, size: int | None = None) -> None:
    """Set up Python workers.

    Arrow batches end at ``size`` (BATCH_BYTES), so that long rows do not pile up in a worker. Workers
    give memory back that a batch no longer needs, as they live on after their task. They
    find this package where the driver has it, if it is not installed for them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size or BATCH_BYTES))
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known.update(WORKER_MEMORY)
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def give_back() -> None:
    """Return what this process has freed to the system, also from the middle of its heap, where the allocator can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches after which a worker, which lives on for later tasks, gives its free memory back."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_bytes(values) -> list[bytes]:
    """UTF-8 bytes of a column of texts; null counts as empty."""
    return [value.encode("utf-8", "surrogatepass") if isinstance(value, str) else b"" for value in values]


def objects(values) -> pd.Series:
    """Texts or bytes as a column, also if there are none (pandas would take an empty list for numbers)."""
    return pd.Series(values, dtype=object)
